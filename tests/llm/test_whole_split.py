"""An oversized text is split or refused, never left out."""

import pytest

from statloom.llm.split import split_text_tokens


def test_letter_run_of_uneven_tokens():
    text = "taxable" * 300 + "".join(chr(0x9F00 + i) for i in range(120))
    found = split_text_tokens(text, 500, 50)
    assert len(found) > 1
    assert found[0][0] == 0 and found[-1][1] == len(text) and all(size <= 500 for *_, size in found)
    assert all(b[0] <= a[1] < b[1] for a, b in zip(found, found[1:]))


def test_no_split_is_an_error():
    with pytest.raises(ValueError):
        split_text_tokens("\U0001f9ff\U0001fab8" * 20, 2, 1)
