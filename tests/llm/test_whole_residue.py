"""Every alternative of the grammars is searched, without another hint near it."""

import pytest

from statloom.llm.residue import residue

ALONE = [
    "Page en construction", "Textes de remplissage", "Substitua este texto", "Aqui va el contenido", "Ici votre texte", "Put your summary", "Type your summary",
    "The page is currently offline.", "The document is not accessible.", "The site was taken offline.", "The file is damaged.", "Closed for routine maintenance. Please wait.",
    "Request Timeout", "Conflict", "Payment Required", "Proxy Authentication Required", "Some content\n404 - Not Found\n",
    "test sample dummy content text copy", "bar baz qux xyz zxcv hjkl",
]


@pytest.mark.parametrize("text", ALONE)
def test_alternative_alone(text):
    assert residue(text)


def test_a_tutorial_is_no_template():
    """However many markers it explains, and whatever else it holds."""
    body = "Real words of content follow here. " * 160
    assert residue("The template placeholder {{x}} is a variable. " * 5 + body) == []
    assert residue("The template placeholder {{x}} is a variable. " * 50 + "Write {{name}} at the top.") == []


def test_a_template_is_no_tutorial():
    assert residue("The marker {{a}} tells {{b}} and {{c}} and {{d}} of {{e}} that {{f}} is due.")
    assert residue("Dear {{name}}, the variable rate is {{rate}}. " * 3)


def test_messages_inside_longer_sentences_are_reports():
    for text in (
        "The court held that a clerk who was told that the page could not be found had no duty to look for it in another county or to ask the other party for a copy.",
        "Access denied to the records of the county by the clerk in charge of them is a ground for an appeal under the section that follows, and for nothing else at all.",
    ):
        assert residue(text) == []


def test_long_paragraphs_take_linear_time():
    quoted = "The manual shows “The quick brown fox jumps over the lazy dog” as a line. " * 20_000
    assert residue(quoted) == []
    assert residue("The quick brown fox jumps over the lazy dog. " * 20_000)
