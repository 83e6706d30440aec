from pyspark.sql import functions as F

from statloom.operators import agent as G

LONG = "what is the sales tax rate on boats and who must collect it"


def test_decompose_falls_back(spark):
    q = spark.createDataFrame([(1, LONG), (2, "short one"), (3, LONG)], "query_id int, query string")
    good = '```json\n{"sub_queries": [{"text": "a", "type": "Penalties", "priority": 9}, {"text": " "}, {"text": "b", "type": "odd", "priority": 0}]}\n```'
    reply = lambda c: F.when(F.lit(True), F.lit(good))
    rows = {(r.query_id, r.sub_idx): (r.text, r.type, r.priority) for r in G.decompose(q.where("query_id < 3"), reply).collect()}
    assert rows == {(1, 0): ("a", "penalty", 5), (1, 1): ("b", "general", 1), (2, 0): ("short one", "general", 1)}
    bad = G.decompose(q.where("query_id = 3"), lambda c: F.lit("no json")).collect()
    assert [(r.text, r.type) for r in bad] == [(LONG, "general")]


def test_relevance_replies(spark):
    df = spark.createDataFrame([("q", "7"), ("q", "none"), ("q", "Score: 25")], "query string, text string")
    assert [r.relevance for r in G.scored_relevance(df, lambda c: F.substring_index(c, "\n", -1)).collect()] == [0.7, 0.5, 1.0]


def test_embedding_cache_and_failed_batches(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, text string")
    cache = spark.createDataFrame([("ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb", [9.0])], "hash string, embedding array<float>")

    def embed(batch):
        if "b" in batch:
            raise RuntimeError
        return [[1.0]] * len(batch)

    got = {r.id: r.embedding for r in G.embedded(texts, cache, embed, "id", 1, 1).collect()}
    assert got == {1: [9.0], 3: [9.0], 2: [0.0], 4: [1.0]}


def test_reports(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, n int")
    assert G.markdown("T", {"x": df}).splitlines()[4:8] == ["| k | n |", "|-|-|", "| a | 1 |", "| b |  |"]
    assert G.settings_problems({"alpha": 2.0, "top_k": 5}) == ["alpha must lie in 0.0..1.0"]
    s = spark.createDataFrame([(429,), (503,), (200,)], "s int").select(G.error_kind(F.col("s"))).collect()
    assert [r[0] for r in s] == ["rate_limited", "service", None]
