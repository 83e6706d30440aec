import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statloom.llm import budget, tokens

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def encoding():
    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


SAMPLES = ["", " ", "\n\n \t", "a", "The tax is 4.5%.", "=" * 3000, "東海商事 " * 50, "naïve café — “x”", "<|endoftext|>", "a" * 2000, "  \n x", "don't we'll", "👩‍👩‍👧 é", "\r\n\r\n1,234.50"]


def test_exact_against_the_tokenizer(encoding):
    assert tokens.TokenCounter().count(SAMPLES) == [len(encoding.encode_ordinary(t)) for t in SAMPLES]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=200))
def test_exact_on_any_text(encoding, text):
    assert tokens.counter().count([text]) == [len(encoding.encode_ordinary(text))]


def test_whole_corpus(encoding, spark, sf):
    rows = tokens.with_tokens(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.col("text").alias("t2")), keep=["doc_id", "t2"]).collect()
    assert all(r.tokens == len(encoding.encode_ordinary(r.t2)) for r in rows) and rows


def test_null_empty_and_full_cache(spark, monkeypatch):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "two words")], "id int, text string")
    assert [r.tokens for r in tokens.with_tokens(df).orderBy("id").collect()] == [0, 0, 2]
    assert tokens.with_tokens(df.limit(0)).count() == 0
    monkeypatch.setattr(tokens, "KEPT_PIECES", 3)
    c = tokens.TokenCounter()
    assert c.count(["one two three four five six"] * 3 + ["seven"]) == [6, 6, 6, 1]


DOCS = "doc_id long, text string, source string, lang string, tax_type string"


def test_budget_counts_equal_texts_once(spark):
    rows = [(1, "the tax of the state is due", "a_b", "EN", "T"), (2, "the tax of the state is due", "A-B ", None, "T"), (3, None, None, None, None), (4, None, None, None, None), (5, "x", "c", "und", " ")]
    got = {(r.source, r.lang, r.domain): (r.n_rows, r.n_counted, r.tokens_all, r.tokens) for r in budget.document_budget(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {("a_b", "en", "T"): (2, 1, 14, 7), (None, "und", None): (2, 2, 0, 0), ("c", "und", None): (1, 1, 1, 1)}
    assert budget.document_budget(spark.createDataFrame([], DOCS)).count() == 0


def test_chunk_budget_counts_parents_and_lost_ones(spark):
    g = spark.createDataFrame([("p", "statute:1", "parent", 99), ("c", "statute:1", "child", -1), ("c", "statute:1", "child", -1), ("o", "rule:2", "child", None), ("n", "rule:3", "parent", 7)], "id string, doc_id string, level string, token_count int")
    d = spark.createDataFrame([("statute:1", "Statute "), ("rule:2", "doc")], "id string, doc_type string")
    t = spark.createDataFrame([("p", "one two three"), ("c", "two"), ("o", "four five")], "id string, text string")
    rows = {r.id: (r.doc_type, r.tokens, r.counted, r.verdict) for r in budget.chunk_tokens(g, d, t).collect()}
    assert rows == {"p": ("statute", 3, True, "differs"), "c": ("statute", 1, False, "impossible"), "o": ("rule", 2, True, "missing"), "n": ("rule", 7, True, "unverified")}


def test_tries_over_partitions_are_exact(encoding, spark):
    rows = [(i, t) for i, t in enumerate([*SAMPLES, *SAMPLES, None, "the tax of the state is due by law"])]
    df = spark.createDataFrame(rows, "id int, text string").repartition(4)
    table = tokens.piece_tokens(df).checkpoint()
    assert table.select("piece").distinct().count() == table.count()
    assert all(r.tokens == len(encoding.encode_ordinary(r.piece)) for r in table.collect())
    want = {i: len(encoding.encode_ordinary(t or "")) for i, t in rows}
    for most in (None, 3):  # looked up in a broadcast table, and by a shuffle on the pieces
        got = tokens.with_piece_tokens(df, table, most=most).collect()
        assert {r.id: r.tokens for r in got} == want and len(got) == len(rows)
        assert {r.found_lang for r in got if r.id == len(rows) - 1} == {"en"}
    empty = df.limit(0)
    assert tokens.with_piece_tokens(empty, tokens.piece_tokens(empty).checkpoint()).count() == 0


def test_counts_beyond_the_old_field(monkeypatch):
    """A text of more tokens than 24 bits hold keeps its count and its language."""
    c = tokens.counter()
    c.count([" the"])
    packed = (c.known[" the"]) * 20_000_000
    assert packed & ((1 << tokens._SHIFT) - 1) == 20_000_000 and tokens.language_of(packed) == "en"


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80), st.integers(0, 30))
def test_truncation_is_exact(encoding, text, most):
    assert tokens.counter().truncate(text, most) == b"".join(encoding.decode_single_token_bytes(t) for t in encoding.encode_ordinary(text)[:most]).decode("utf-8", "ignore")


def test_truncate_operator(spark):
    df = spark.createDataFrame([(1, "one two three four"), (2, None), (3, "")], "id int, text string")
    assert [(r.id, r.text) for r in tokens.truncated(df, 2).orderBy("id").collect()] == [(1, "one two"), (2, ""), (3, "")]
