import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statloom.llm import mixing, packing, tokens


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_every_item_once_and_no_container_too_full(lengths):
    groups = packing.pack(lengths, 50)
    assert sorted(i for g in groups for i in g) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in g) <= 50 for g in groups)
    if lengths and sum(lengths):  # at most one container is half empty
        assert sum(sum(lengths[i] for i in g) * 2 <= 50 for g in groups) <= 1


def test_harmonic_classes():
    assert [packing.harmonic_class(n, 100) for n in (100, 51, 50, 34, 33, 1, 0)] == [1, 1, 2, 2, 3, 100, 100]
    assert len(packing.pack([50] * 10, 100)) == 5 and len(packing.pack([34] * 4, 100)) == 2


def test_pack_operator(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = packing.pack_documents(docs, 128)
    sizes = {r.doc_id: r.tokens for r in tokens.with_tokens(docs, keep=["doc_id"]).collect()}
    per = {r.doc_id: r.t for r in out.groupBy("doc_id").agg(F.sum("tokens").alias("t")).collect()}
    assert per == sizes
    full = out.groupBy("container_id").agg(F.sum("tokens").alias("t"), F.max("container_tokens").alias("c")).collect()
    assert all(r.t == r.c <= 128 for r in full)
    assert out.where("part > 0").select("doc_id").distinct().count() == sum(n > 128 for n in sizes.values())


def test_pack_null_empty_and_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.tokens) for r in packing.pack_documents(df, 2).collect()) == [(1, 0), (2, 0), (3, 1), (3, 2)]
    assert packing.pack_documents(df.limit(0), 10).count() == 0


def test_permutation_and_dealing(spark):
    for n in (1, 2, 3, 1000, 4097):
        assert sorted(mixing.permuted(np.arange(n), n, 7)) == list(range(n))
    quota, blocks = [7000, 500, 0, 3], [2000, 600, 5, 3]
    plan = pd.DataFrame({"slots": quota, "blocks": blocks})
    slots = mixing.shard_slots(spark, plan, 1, 64).toPandas()
    assert list(slots.groupby("source_no").size().reindex(range(4), fill_value=0)) == quota
    for no, g in slots.groupby("source_no"):  # every block once a pass
        uses = g.groupby("block").size()
        assert uses.max() - (uses.min() if len(uses) == blocks[no] else 0) <= 1 and g["block"].between(0, blocks[no] - 1).all()
    # the counts are drawn, not dealt evenly: their spread is that of multinomial draws
    n = slots[slots.source_no == 1].groupby("shard").size().reindex(range(118), fill_value=0)
    p = 500 / sum(quota)
    assert 0.5 < n[:-1].var() / (64 * p * (1 - p)) < 2


MIX = "source string, target_share double, max_repeats int"


def test_mix_meets_the_shares(spark, sf):
    docs, targets = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/mix_targets.parquet")
    chosen, plan = mixing.mix(spark, docs, targets)
    rows = chosen.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.uses <= r.max_repeats and 0 < r.used_tokens <= r.uses * r.tokens for r in rows)
    for r in mixing.share_report(chosen, plan).collect():
        most = r.available * r.max_repeats
        assert abs(r.used_tokens - min(r.wanted, most)) <= mixing.BLOCK_TOKENS, r
        assert r.capped == (r.wanted > most)


def test_blocks_are_of_fixed_length(spark, sf):
    docs, targets = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/mix_targets.parquet")
    sized = mixing.sized_documents(docs, targets)
    per = mixing.spans(sized).groupBy("source", "block").agg(F.sum("span_tokens").alias("n")).toPandas()
    for _, g in per.groupby("source"):
        assert (g.sort_values("block")["n"].to_numpy()[:-1] == mixing.BLOCK_TOKENS).all()
    whole = mixing.spans(sized).groupBy("doc_id").agg(F.sum("span_tokens").alias("n"), F.first("tokens").alias("t"))
    assert whole.where("n <> t").count() == 0
    chosen = mixing.mix_spans(spark, docs, targets)[0]
    assert chosen.where("size(shards) <> uses or uses > max_repeats").count() == 0


def test_mix_edges(spark):
    docs = spark.createDataFrame([(1, "a a a", "x"), (2, None, "x"), (3, "b", None), (4, "c c", "other"), (5, "d", " X")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("x", 0.9, 2), ("gone", 0.1, 3), ("x", 0.9, 2)], MIX)
    rows = {r.doc_id: r.uses for r in mixing.mix(spark, docs, targets)[0].collect()}
    assert set(rows) <= {1, 5} and all(n <= 2 for n in rows.values())
    assert mixing.mix(spark, docs.limit(0), targets)[0].count() == 0
