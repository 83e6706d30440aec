import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import answers, chunking, corpus, evaluation, graph, observe
from statloom.operators import retrieval as R


def test_subsections_follow_the_marker_rules(spark):
    text = "Preamble\n(1)\nfirst\n(2)\n(3)\nthird\n(4)\n  \n(a)\nx"
    got = spark.createDataFrame([(text,)], "t string").select(chunking.subsections(F.col("t"))).first()[0]
    assert [(x.marker, x.content) for x in got] == [("(1)", "first"), ("(2)", "(3)\nthird"), ("(4)", "(a)\nx")]
    assert spark.createDataFrame([("no marker",)], "t string").select(chunking.subsections(F.col("t"))).first()[0] == []


def test_taa_sections_and_packing(spark):
    text = "TAA 1\nFACTS\nabc\nCONCLUSION\ndef\nFACTS\nagain"
    got = spark.createDataFrame([(text,)], "t string").select(chunking.taa_sections(F.col("t"))).first()[0]
    assert [(x.marker, x.content) for x in got] == [("FACTS", "abc"), ("CONCLUSION", "def\nFACTS\nagain")]
    packed = spark.createDataFrame([("a b c\n\nd e\n\nf g h i\n\nj",)], "t string").select(chunking.packed_paragraphs(F.col("t"), 5)).first()[0]
    assert packed == ["a b c\n\nd e", "f g h i\n\nj"]


def test_parents_cover_documents(spark):
    docs = spark.createDataFrame([("statute:1", "statute", "x\n(1)\na\n(2)\nb"), ("other:1", "other", "y"), ("case:1", "case", None)], "id string, doc_type string, text string").withColumns({"ancestry": F.lit("root > x"), "citation": F.lit("c"), "effective_date": F.lit(None).cast("date")})
    rows = chunking.chunk_documents(docs).collect()
    by = {r.id: r for r in rows}
    assert by["chunk:statute:1:0"].child_chunk_ids == ["chunk:statute:1:1", "chunk:statute:1:2"] and by["chunk:statute:1:1"].child_chunk_ids == []
    assert by["chunk:statute:1:2"].text_with_ancestry == "root > x\n\nb" and by["chunk:statute:1:2"].token_count == 4 and by["chunk:case:1:0"].text_with_ancestry == "root > x\n\n"
    assert {r.doc_id for r in rows if r.level == "parent"} == {"statute:1", "other:1", "case:1"}
    assert [r.id for r in rows if r.level == "child"] == ["chunk:statute:1:1", "chunk:statute:1:2"]
    assert all(r.parent_chunk_id.endswith(":0") for r in rows if r.level == "child")


def test_rules_and_cases_normalise(spark):
    rule = spark.createDataFrame([({"rule_number": "12A-1.001", "title": "", "chapter": "12A-1", "effective_date": None, "rulemaking_authority": ["b", "a"], "law_implemented": ["a"], "references_statutes": None}, "t", "u", None)], "metadata struct<rule_number:string,title:string,chapter:string,effective_date:date,rulemaking_authority:array<string>,law_implemented:array<string>,references_statutes:array<string>>, text string, source_url string, scraped_at timestamp")
    r = corpus.rules_to_documents(rule).first()
    assert (r.id, r.title, r.parent_id, r.cites_statutes) == ("rule:12A-1.001", "Rule 12A-1.001", "rule:chapter_12A-1", ["a", "b"])
    case = spark.createDataFrame([({"cluster_id": 7, "case_name": "A v. B", "date_filed": None, "statutes_cited": [], "cases_cited": [1, 2]}, "o", "u", None)], "metadata struct<cluster_id:int,case_name:string,date_filed:date,statutes_cited:array<string>,cases_cited:array<int>>, opinion_text string, source_url string, scraped_at timestamp")
    assert corpus.cases_to_documents(case).first().cites_cases == ["case:1", "case:2"]


def test_rerank_rules(spark):
    rows = [("q", 1, "c", "case", 0.9), ("q", 2, "s", "statute", 0.85), ("q", 3, "t", "taa", 0.95), ("q", 4, "s", "statute", 0.84)]
    df = spark.createDataFrame(rows, "query_id string, rank int, doc_id string, doc_type string, score double").withColumn("effective_date", F.lit(None).cast("date")).withColumn("graph_boost", F.lit(0.0))
    out = R.rerank(df, "2025-01-01").orderBy("new_rank").collect()
    assert [(r.doc_id, r.new_score) for r in out] == [("s", 0.85), ("s", 0.74), ("c", 0.72), ("t", 0.665)]


def test_recency(spark):
    df = spark.createDataFrame([("2030-01-01",), ("2025-01-01",), ("2010-01-01",), (None,)], "d string").select(F.col("d").cast("date").alias("d"))
    got = [r[0] for r in df.select(R.recency(F.col("d"), "2025-01-01")).collect()]
    assert got == [1.1, 1.1, 0.9, 1.0]


def test_cosine_paths_agree(spark, sf, monkeypatch):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.where("vec_id % 50 = 0")
    near = R.vector_top_k(v, q, 5)
    pairs = near.join(v.alias("a").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("ea")), "query_id").join(v.select("vec_id", F.col("embedding").alias("eb")), "vec_id")
    assert pairs.where(F.abs(R.cosine(F.col("ea"), F.col("eb")) - F.col("score")) > 1e-6).count() == 0
    assert near.count() == 5 * q.count()
    whole = sorted(map(tuple, near.collect()))
    monkeypatch.setattr(R, "MOST_QUERIES", 4)
    assert sorted(map(tuple, R.vector_top_k(v, q, 5).collect())) == whole


def test_floor_and_merge(spark):
    rows = [("q", i, 0.2) for i in range(1, 16)]
    df = spark.createDataFrame(rows, "query_id string, rank int, relevance double")
    assert R.relevant_or_first(df, 0.5).count() == 10
    m = R.merge_subqueries(spark.createDataFrame([(1, 0, "a", 0.5), (1, 1, "a", 0.7), (1, 0, "b", 0.6)], "query_id int, sub_idx int, doc string, score double"), "doc")
    assert {r.doc: (r.score, r.matches, r.matched) for r in m.collect()} == {"a": (0.8, 2, "0,1"), "b": (0.6, 1, "0")}


@pytest.mark.parametrize("hit, rr", [(1, 1.0), (2, 0.5), (3, 1 / 3), (9, 0.0)])
def test_reciprocal_rank(spark, hit, rr):
    results = spark.createDataFrame([("q", i, i) for i in range(1, 6)], "query_id string, rank int, item int")
    relevant = spark.createDataFrame([("q", hit)], "query_id string, item int")
    m = evaluation.ranking_metrics(results, relevant, 5).first()
    assert m.rr == pytest.approx(rr) and 0 <= m.ndcg <= 1 and m.recall == (1.0 if rr else 0.0)


def test_shortest_paths_on_a_small_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d")], "src string, dst string")
    got = {r.id: (r.hops, r.path) for r in graph.shortest_paths(e, ["a"], 3).collect()}
    assert got["c"] == (2, ["a", "b", "c"]) and got["d"] == (3, ["a", "b", "c", "d"]) and got["a"] == (0, ["a"])


def test_chain_takes_the_two_hop_readers(spark):
    v = spark.createDataFrame([("s", "statute"), ("r", "rule"), ("c", "case"), ("t", "taa")], "id string, doc_type string")
    e = spark.createDataFrame([("r", "s", "implements"), ("c", "r", "interprets"), ("t", "s", "cites")], "src string, dst string, relation string")
    chain = graph.interpretation_chain(v, e)
    assert {(r.part, r.other) for r in chain.collect()} == {(0, "r"), (1, "c"), (2, "t")}
    assert {(r.part, r.n, tuple(r.first)) for r in graph.chain_lists(chain, 1).collect()} == {(0, 1, ("r",)), (1, 1, ("c",)), (2, 1, ("t",))}


def test_limiter_and_cache_against_a_loop(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts")
    got = {r.event_id: r.passed for r in observe.limited(ev, "user_id", "ts", 2, 86400, ["ts", "event_id"]).collect()}
    want, state = {}, {}
    for r in ev.toPandas().sort_values(["user_id", "ts", "event_id"]).itertuples():
        kept = [x for x in state.get(r.user_id, []) if x > r.ts - pd.Timedelta(seconds=86400)]
        want[r.event_id] = len(kept) < 2
        state[r.user_id] = kept + [r.ts] if len(kept) < 2 else kept
    assert got == want


def test_percentile_index(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)], "k string, v double")
    r = observe.percentile_at(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (r.p50, r.p95) == (5.0, 9.0)
    many = spark.range(20000).select(F.when(F.col("id") % 7 > 0, "x").alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 977).cast("double").alias("v"))
    shares = {"p0": 0.0, "p33": 0.33, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.k: r for r in observe.percentile_at(many, ["k"], "v", shares).collect()}
    for k, g in many.toPandas().groupby("k", dropna=False):
        v = sorted(g["v"].dropna())
        row = got[None if k != k or k is None else k]
        assert [row[n] for n in shares] == [v[min(int(len(v) * p), len(v) - 1)] for p in shares.values()]


def test_corrections_replace_only_the_first(spark):
    h = F.array(F.struct(F.lit("a").alias("claim_text"), F.lit("b").alias("suggested_correction"), F.lit(0.1).alias("severity")))
    r = spark.createDataFrame([("a a",)], "t string").select(answers.simple_corrections(F.col("t"), h).alias("r")).first().r
    assert (r.text, r.corrected) == ("b a", 1)


def test_replies(spark):
    df = spark.createDataFrame([('```json\n{"overall_accuracy": 0.9, "hallucinations": []}\n```',), ("{\"overall_accuracy\": 0.5}",), ("no json",)], "t string")
    assert [r[0] for r in df.select(answers.reply(F.col("t"))["overall_accuracy"]).collect()] == [0.9, 0.5, None]


def test_agent_loop_is_bounded(spark):
    start = spark.createDataFrame([(1, 0), (2, 5)], "id int, n int")
    out = answers.agent_loop(start, lambda d: d.withColumn("n", F.col("n") + 1), lambda d: F.col("n") >= 3, 2)
    assert sorted((r.id, r.n) for r in out.collect()) == [(1, 2), (2, 6)]


def test_plans_stay_pushed_down(spark, sf, capsys):
    from statloom.queries.ingest import edges_confident

    edges_confident(spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(confidence,0.5)" in plan and "citation_text" not in plan.split("ReadSchema")[1].split("\n")[0]
