import random

import pytest

from statloom.llm import split, tokens

TEXTS = ["x" * 9001, "\r\n" * 4000, "é" * 4000, "word " * 1500, "Sentence one is here. " * 300, "(1) a\n" * 900, "a\n\n" * 2000, "東海商事。" * 800]


@pytest.mark.parametrize("text", TEXTS)
def test_pieces_fit_and_join(text):
    p = split.split_text(text, 3000, 200)
    assert all(0 < e - s <= 3000 for s, e, _ in p)
    assert all(b[0] == a[1] - 200 for a, b in zip(p, p[1:]))
    assert p[0][0] == 0 and p[-1][1] == len(text)
    assert text[: p[0][1]] + "".join(text[b[0] + 200 : b[1]] for b in p[1:]) == text
    assert not any(text[e - 1 : e + 1] == "\r\n" for _, e, k in p if k == "none")


def test_natural_cuts_win():
    text = "\n".join(f"({i})\n" + f"This is a sentence of section {i}. " * 30 for i in range(1, 7))
    assert {k for *_, k in split.split_text(text, 3000, 200)} == {"subsection", "end"}


def test_dynamic_programming_is_optimal():
    """Against all splits of small inputs."""
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(2, 9)
        at = [0, *sorted(rng.sample(range(1, 60), n)), 60]
        pen = [0.0, *(rng.random() * 3 for _ in range(n)), 0.0]
        limit, overlap = 25, rng.randint(0, 6)
        best = _brute(at, pen, limit, overlap)
        got = split._best(at, pen, at, limit, overlap)
        assert (got is None) == (best is None)
        if got is not None:
            assert _cost(got, at, pen, limit, overlap) == pytest.approx(best)


def _cost(cuts, at, pen, limit, overlap):
    ideal = at[-1] / max(1, -(-(at[-1] - overlap) // (limit - overlap)))
    total, i = 0.0, 0
    for j in cuts:
        length = at[j] - at[i] + (overlap if i else 0)
        if length > limit:
            return None
        total += split.BALANCE * ((length - ideal) / limit) ** 2 + pen[j]
        i = j
    return total


def _brute(at, pen, limit, overlap):
    from itertools import combinations

    inner = range(1, len(at) - 1)
    costs = [_cost([*c, len(at) - 1], at, pen, limit, overlap) for k in range(len(at)) for c in combinations(inner, k)]
    return min((c for c in costs if c is not None), default=None)


@pytest.mark.parametrize("text", ["a b. " * 2000, "x" * 3000, "東海商事" * 500, "= " * 2000, "One two three. Four five six!\n" * 200])
def test_token_pieces_fit(text):
    c = tokens.counter()
    p = split.split_text_tokens(text, 500, 50)
    assert p[0][0] == 0 and p[-1][1] == len(text)
    assert all(b[0] <= a[1] for a, b in zip(p, p[1:]))
    assert all(c.count([text[s:e]])[0] <= 500 for s, e, *_ in p)


def test_operator(spark):
    df = spark.createDataFrame([("a", "y" * 3001, 5), ("b", "short", 6), ("c", None, 7), ("d", "", 8), ("a", "y" * 3001, 5)], "chunk_id string, text string, piece int")
    out = split.split_oversized(df, 3000, 200, ["chunk_id", "piece"])
    assert out.columns == ["chunk_id", "piece", "n_pieces", "start", "end", "cut", "size", "piece_text"]
    rows = out.collect()
    assert {r.chunk_id for r in rows} == {"a"} and len(rows) == 4 and all(len(r.piece_text) == r.size for r in rows)
    assert split.split_oversized(df.limit(0), 3000, 200, ["chunk_id"]).count() == 0
    with pytest.raises(ValueError):
        split.split_text("x" * 10, 5, 5)
