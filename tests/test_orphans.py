from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from statloom.operators import orphans as O

REFS = "src_table string, src_key string, src_field string, ref_value string, ref_time timestamp, ref_kind string, ref_key string"


def keys(spark, values, kind=None):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(O.document_key(F.col("v"), kind)).collect()]


def test_spelling_does_not_matter(spark):
    assert set(keys(spark, ["statute:212.05", " STATUTE: 212.05 ", "statute:212.05(1)(a)2.", "Statute:§ 212.05", "statute:212.05"])) == {"statute:212.05"}
    assert set(keys(spark, ["212.05", "§ 212.05", "Section 212.05(3)", "Fla. Stat. § 212.05", "s. 212.05", "212.05, F.S."], "statute")) == {"statute:212.05"}
    assert set(keys(spark, ["12A-1.005", "Rule 12a–1.005, F.A.C.", "R. 12A-1.005(2)", " 12A‑1.005"], "rule")) == {"rule:12a-1.005"}
    assert set(keys(spark, ["taa:TAA_23A00-001", "taa:TAA 23A00-001", "TAA: taa_23a00-001"])) == {"taa:23a00-001"}


def test_null_and_blank_refer_to_nothing(spark):
    assert keys(spark, [None, "", "  ", "_"]) == [None] * 4


@pytest.fixture(scope="module")
def parents(spark):
    rows = [
        ("statute:1.01", D(2020, 1, 1), None), ("statute:1.02", D(2020, 1, 1), D(2021, 1, 1)),
        ("statute:1.03", D(2020, 1, 1), D(2021, 1, 1)), ("statute:1.03", D(2022, 1, 1), None),  # came back
        ("statute:1.04", D(2023, 1, 1), None), ("statute:1.05", D(2020, 1, 1), D(2021, 1, 1)), ("statute:1.05", D(2020, 1, 1), None),  # tie
        ("statute:1.06", None, None), (None, D(2020, 1, 1), None),
    ]
    df = spark.createDataFrame(rows, "id string, at timestamp, deleted_at timestamp")
    return O.parent_state(df, O.document_key(F.col("id")), F.col("at"), F.col("deleted_at")).withColumn("ref_kind", F.lit("document"))


def test_reasons(spark, parents):
    t = D(2022, 6, 1)
    rows = [("t", str(i), "f", k, t, "document", k) for i, k in enumerate([f"statute:1.0{n}" for n in range(1, 8)])]
    rows += [("t", "8", "f", "statute:1.04", None, "document", "statute:1.04"), ("t", "9", "f", None, t, "document", None), rows[6]]
    out = {(r.src_key, r.reason) for r in O.orphan_references(spark.createDataFrame(rows, REFS), parents).collect()}
    assert out == {("1", "deleted"), ("3", "not_yet"), ("6", "missing")}


def test_hot_key_and_empty(spark, parents):
    t = D(2022, 6, 1)
    hot = spark.range(5000).select(F.lit("t").alias("src_table"), F.col("id").cast("string").alias("src_key"), F.lit("f").alias("src_field"), F.lit("x").alias("ref_value"), F.lit(t).alias("ref_time"), F.lit("document").alias("ref_kind"), F.lit("statute:9.9").alias("ref_key"))
    assert O.orphan_references(hot, parents).count() == 5000
    assert O.orphan_references(spark.createDataFrame([], REFS), parents).count() == 0
    assert O.orphan_references(hot.limit(3), parents.limit(0)).count() == 3


def test_report_counts(spark, parents):
    t = D(2022, 6, 1)
    rows = [("t", "1", "f", "a", t, "document", "statute:1.01"), ("t", "2", "f", "b", t, "document", "statute:1.02"), ("t", "3", "f", "c", None, "document", "statute:7.77")]
    refs = spark.createDataFrame(rows, REFS)
    got = {(r.month, r.n_refs, r.n_orphans, r.n_deleted, r.n_missing) for r in O.orphan_report(refs, O.orphan_references(refs, parents)).collect()}
    assert got == {("2022-06", 2, 1, 1, 0), (None, 1, 1, 0, 1)}
