"""Registered queries read all of their input."""

from pyspark.sql import functions as F

from statloom.operators import answers as A
from statloom.operators import retrieval as R
from statloom.plans import pipeline
from statloom.queries import all_queries


def test_citation_graph_reads_children(spark, tmp_path):
    rows = [
        ("chunk:statute:1.01:0", "statute:1.01", "parent", "No citation.", "Fla. Stat. § 1.01", "statute"),
        ("chunk:statute:1.01:1", "statute:1.01", "child", "See section 2.02, F.S.", "Fla. Stat. § 1.01", "statute"),
        ("chunk:statute:2.02:1", "statute:2.02", "child", "See section 1.01, F.S.", "Fla. Stat. § 2.02", "statute"),
    ]
    spark.createDataFrame([*rows, rows[1]], "id string, doc_id string, level string, text string, citation string, doc_type string").write.parquet(f"{tmp_path}/legal_chunks.parquet")
    found = all_queries()["citation_graph"](spark, str(tmp_path)).collect()
    assert sorted((r["source_chunk_id"], r["target_doc_id"], r["target_chunk_id"]) for r in found) == [
        ("chunk:statute:1.01:1", "statute:2.02", "chunk:statute:2.02:1"),
        ("chunk:statute:2.02:1", "statute:1.01", "chunk:statute:1.01:0"),
    ]


def test_pipeline_fuses_vectors_and_graph(spark):
    day = "2020-01-01"
    docs = spark.createDataFrame([(1, "sales tax", "statute", "1.01", "statute:1.01"), (2, "other words", "statute", "2.02", "statute:2.02"), (3, "unlike", "statute", "3.03", "statute:3.03")], "doc_id long, text string, doc_type string, section string, graph_id string").withColumn("effective_date", F.lit(None).cast("date"))
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (9, [1.0, 0.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    edges = spark.createDataFrame([("statute:2.02", "statute:3.03", "cites")], "source_doc_id string, target_doc_id string, relation_type string")
    verts = spark.createDataFrame([(f"statute:{s}", "statute", "", "", s, "1") for s in ("1.01", "2.02", "3.03")], "id string, doc_type string, title string, full_citation string, section string, chapter string")
    got = pipeline.retrieve(docs, spark.createDataFrame([(2, "sales tax")], "query_id int, query string"), vectors, asked, edges, verts, day, 3).orderBy("rank").collect()
    # fused scores 0.5 (keyword alone), 0.5 (vector alone), 0; boosts 0, 0.05 + 0.02, 0.02
    assert [(r["doc_id"], round(r["score"], 6)) for r in got] == [(2, 0.57), (1, 0.5), (3, 0.02)]


def test_faithfulness_counts_every_event(spark, sf):
    found = all_queries()["faithfulness"](spark, sf)
    assert found.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_source_texts_fall_back_to_part_of_citation(spark):
    found = spark.createDataFrame([(1, 0, "1.01"), (1, 1, "2.02"), (1, 2, "9.99"), (1, 3, "Fla. Stat. § 2.02(3)")], "raw_id int, position int, source string")
    chunks = spark.createDataFrame(
        [(1, "c0", "statute:1.01", "Fla. Stat. § 1.01", 1), (1, "c1", "case:1", "A v. B, see 2.02", 2), (1, "c2", "statute:12.02", "Fla. Stat. § 2.02(3)", 3), (1, "c3", "case:1", "A v. B", 4)],
        "raw_id int, chunk_id string, doc_id string, citation string, rank int",
    )
    got = {r["position"]: r["source_chunk_id"] for r in A.source_texts(found, chunks, "raw_id").collect()}
    assert got == {0: "c0", 1: "c3", 2: None, 3: "c2"}


def test_bm25_takes_any_number_of_queries(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} common text") for i in range(6)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"word{i} common") for i in range(6)], "query_id int, query string")
    whole = sorted(map(tuple, R.bm25(docs, asked, "doc_id", 3).collect()))
    monkeypatch.setattr(R, "MOST_QUERIES", 2)
    assert sorted(map(tuple, R.bm25(docs, asked, "doc_id", 3).collect())) == whole
    assert {r[0] for r in whole} == set(range(6))
