"""Rules that must hold for null keys, hot keys and large inputs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import citations, graph, observe
from statloom.operators import retrieval as R

T0 = dt.datetime(2024, 1, 1)


def rows(keys, seconds):
    return [(i, k, T0 + dt.timedelta(seconds=s)) for i, (k, s) in enumerate(zip(keys, seconds))]


def brute(events, limit, window):
    out, passed = {}, {}
    for i, k, t in sorted(events, key=lambda r: (r[2], r[0])):
        kept = [x for x in passed.get(k, []) if x > t - dt.timedelta(seconds=window)]
        if len(kept) < limit:
            kept.append(t)
            out[i] = True
        else:
            out[i] = False
        passed[k] = kept
    return out


def test_limiter_null_key_is_one_key(spark):
    df = spark.createDataFrame(rows([None] * 3 + [1], [0, 0, 0, 0]), "event_id long, user_id long, ts timestamp")
    got = {r.event_id: r.passed for r in observe.limited(df, "user_id", "ts", 1, 60, ["ts", "event_id"]).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True}
    hits = {r.event_id: r.hit for r in observe.cached(df, "user_id", "ts", 60, ["ts", "event_id"]).collect()}
    assert hits == {0: False, 1: True, 2: True, 3: False}


def test_limiter_cut_at_pauses_is_exact(spark):
    rng = np.random.default_rng(3)
    gaps = rng.choice([1, 5, 30, 59, 60, 61, 500, 4000], 1500)
    events = rows([int(k) for k in rng.choice([1, 1, 1, 2], 1500)], [int(x) for x in gaps.cumsum()])
    df = spark.createDataFrame(events, "event_id long, user_id long, ts timestamp")
    got = {r.event_id: r.passed for r in observe.limited(df, "user_id", "ts", 2, 60, ["ts", "event_id"]).collect()}
    assert got == brute(events, 2, 60)
    runs = observe.pauses(df, "user_id", "ts", 60).groupBy("user_id").agg(F.countDistinct("__run").alias("n")).collect()
    assert all(r.n > 1 for r in runs)  # a busy key is several tasks' work


def test_interpolated_percentiles(spark):
    values = [float(x) for x in np.random.default_rng(1).integers(0, 50, 2001)]
    df = spark.createDataFrame([("a", v) for v in values] + [(None, 3.0), ("a", None)], "k string, v double")
    got = {r.k: r for r in observe.interpolated(df, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).collect()}
    for name, p in (("p50", 50), ("p95", 95), ("p99", 99)):
        assert got["a"][name] == pytest.approx(np.percentile(values, p), abs=1e-6) and got[None][name] == 3.0


def test_bm25_ways_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"tax on item {i % 7} and fuel {i % 3} tax") for i in range(60)] + [(60, None), (61, "")], "doc_id long, text string")
    qs = spark.createDataFrame([(1, "fuel tax"), (2, "item 3"), (3, "nothing like it"), (4, "")], "query_id int, query string")
    one = sorted(map(tuple, R.bm25(docs, qs, "doc_id", 5).collect()))
    monkeypatch.setattr(R, "MOST_TERMS", 1)
    assert sorted(map(tuple, R.bm25(docs, qs, "doc_id", 5).collect())) == one and {r[0] for r in one} == {1, 2}


def test_vector_search_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 8))
    m[7] = m[9]  # a tie
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, R.vector_top_k(df, df.where("vec_id % 20 = 0"), 5).collect()))
    monkeypatch.setattr(R, "TILE", 16)
    assert sorted(map(tuple, R.vector_top_k(df, df.where("vec_id % 20 = 0"), 5).collect())) == whole and len(whole) == 75


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, None, 5)], "id long, kind string, n int")
    ids = lambda f: sorted(r.id for r in R.matching(df, f).collect())
    assert ids(None) == [1, 2, 3] and ids({"kind": ["a", "b"]}) == [1, 2] and ids({"kind": ["a", "b"], "n": 5}) == [1] and ids({"kind": None}) == [1, 2, 3]


def test_resolution_of_a_hot_section(spark):
    cited = spark.createDataFrame([(i, "statute", "212.05(1)", "212.05(1)", "x") for i in range(200)] + [(200, "chapter", "212", "chapter 212", "x"), (201, "case", None, "1 So. 2d 3", "x")], "id long, kind string, section string, normalized string, context string")
    chunks = spark.createDataFrame([("chunk:statute:212.05:1", "statute:212.05", "statute", "§ 212.05"), ("chunk:statute:212.05:0", "statute:212.05", "statute", "§ 212.05"), ("c:9", "case:9", "case", "A v. B, 1 So. 2d 3")], "id string, doc_id string, doc_type string, citation string")
    got = citations.resolve(cited, citations.document_index(chunks)).collect()
    assert len(got) == 202
    by = {r.id: r for r in got}
    assert by[0].target_chunk_id == "chunk:statute:212.05:0" and by[0].confidence == 0.8 and by[200].target_doc_id is None and by[200].confidence == 0.0
    assert by[201].target_doc_id == "case:9" and by[201].confidence == 0.9


def test_rows_without_a_document_do_not_penalise_each_other(spark):
    df = spark.createDataFrame([(1, r, d, "statute", None, 0.8, 0.0) for r, d in ((1, "row:1"), (2, "row:2"), (3, "statute:1"), (4, "statute:1"))], "query_id int, rank int, doc_id string, doc_type string, effective_date date, score double, graph_boost double")
    got = {r["rank"]: r.new_score for r in R.rerank(df, "2024-01-01").collect()}
    assert got == {1: 0.8, 2: 0.8, 3: 0.8, 4: 0.7}


def test_expansion_of_results(spark):
    chunks = spark.createDataFrame([("c:a:0", "a", "parent", None), ("c:a:1", "a", "child", "c:a:0"), ("c:b:0", "b", "parent", None), ("c:b:1", "b", "parent", None)], "id string, doc_id string, level string, parent_chunk_id string")
    docs = spark.createDataFrame([(x, "statute", x, x, "1", "1") for x in "ab"], "id string, doc_type string, title string, full_citation string, section string, chapter string")
    raw = spark.createDataFrame([(1, "c:a:1", "a", "b", "cites", "t", 0.9)], "edge_id long, source_chunk_id string, source_doc_id string, target_doc_id string, relation_type string, citation_text string, confidence double")
    verts = graph.vertices(docs)
    results = spark.createDataFrame([(1, 1, "c:a:1"), (1, 2, "c:b:0")], "query_id int, rank int, id string")
    got = {(r["rank"], r.source, r.position, r.item) for r in graph.expand_results(results, chunks, verts, graph.linked(raw, verts), raw).collect()}
    assert got == {(1, "parent", 1, "c:a:0"), (1, "context", 1, "b"), (1, "related", 1, "c:b:0"), (2, "related", 1, "c:a:0")}


def test_subqueries_in_one_batch(spark):
    from statloom.plans import pipeline

    docs = spark.createDataFrame([(1, "fuel tax"), (2, "boat lease"), (3, "fuel lease")], "doc_id long, text string")
    subs = spark.createDataFrame([(1, 0, "fuel"), (1, 1, "lease"), (1, 2, None), (2, 0, "boat")], "query_id int, sub_idx int, text string")
    got = {(r.query_id, r.doc_id): (r.matches, r.matched) for r in pipeline.retrieve_all(docs, subs).collect()}
    assert got == {(1, 1): (1, "0"), (1, 2): (1, "1"), (1, 3): (2, "0,1"), (2, 2): (1, "0")}


def test_relevance_is_joined_and_missing_stays(spark):
    r = spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, item string")
    s = spark.createDataFrame([(1, "a", 0.2), (1, "a", 0.7)], "query_id int, item string, relevance double")
    assert {x.item: x.relevance for x in R.with_relevance(r, s, ["query_id", "item"]).collect()} == {"a": 0.7, "b": None}


def test_vector_index(spark, tmp_path):
    from statloom.operators import vector_index as V

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    m = centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * 0.3
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(5000, None), (5001, [1.0]), (5002, [0.0] * 16), (7, [float(x) for x in m[7]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = V.tuned_probes(spark, V.build(df, 16, str(tmp_path / "i")), df.where("size(embedding) = 16"))
    assert index.read(spark).count() == len(rows) and 1 <= index.probes < len(index.cells)
    asked = df.where("vec_id % 20 = 0 and vec_id < 3000")
    got = V.recall(V.search(spark, index, asked), R.vector_top_k(df.where("size(embedding) = 16"), asked)).first()
    assert got.n_queries == 150 and got.recall >= 0.9
    whole = V.search(spark, index, asked, probes=10_000)
    assert sorted(map(tuple, whole.select("query_id", "vec_id", "score").collect())) == sorted(map(tuple, R.vector_top_k(df.where("size(embedding) = 16"), asked).select("query_id", "vec_id", "score").collect()))
    assert V.search(spark, index, asked.limit(0)).count() == 0
    empty = V.build(df.limit(0), 16, str(tmp_path / "e"))
    assert V.search(spark, empty, asked).count() == 0


def test_paths_from_several_sources_and_their_segments(spark):
    e = spark.createDataFrame([("a", "b", "cites"), ("c", "b", "implements"), ("b", "a", "amends"), ("c", "d", "cites")], "src string, dst string, relation string")
    paths = graph.shortest_paths(e, ["a", "d"], 3)
    got = {(r.source, r.id): r.hops for r in paths.collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("d", "d"): 0, ("d", "c"): 1, ("d", "b"): 2, ("d", "a"): 3}
    seg = {(r.source, r.id, r.step): (r.src, r.dst, r.relation, r.forward) for r in graph.path_segments(paths, e).collect()}
    assert seg["a", "c", 1] == ("a", "b", "cites", True) and seg["a", "c", 2] == ("c", "b", "implements", False) and seg["d", "a", 3] == ("b", "a", "amends", True)
