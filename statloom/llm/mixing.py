"""Mixing sources to target weights.

Each source's tokens, its documents laid end to end in the order of a seeded hash, are packed into
blocks of ``BLOCK_TOKENS`` tokens (the last one of a source may be shorter); a document is the spans
it has in blocks.  A source's quota is its share of the total, in blocks, at most ``max_repeats``
times what it has.  Every output shard draws the number of its slots for each source from a
multinomial distribution over the quotas; the cumulated counts of each source are then stretched so
that they end at its quota exactly.  A source's slots run through its blocks in the order of a
pseudorandom index permutation, a new one each pass, and spans are joined to slots by block index.

Running sums over a source are made in two levels (sums per range, then within the range), so a
source that holds most of the rows is never one task's work.  Only per-source totals (as many rows
as there are targets) reach the driver.

Defined edge cases: sources are matched after folding their spelling; documents of other or no
sources are left out but count into the total; null and empty texts have 0 tokens and are never
chosen; a source that cannot reach its share within ``max_repeats`` uses gives all it may, and the
report says so; targets repeated in the table count once; an empty corpus gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.llm.budget import folded_source
from statloom.llm.tokens import VOCABULARY, with_tokens
from statloom.session import ensure_checkpoint_dir

#: Tokens of a block, slots of an output shard, and hash ranges of a source (shards of a range too).
BLOCK_TOKENS, SHARD_SLOTS, RANGES = 256, 1024, 1024
SEED = 42
#: Slots written by one task.
SLOTS_A_TASK = 1_000_000
#: Most targets: the table of targets is a fixed, small one.
MOST_TARGETS = 10_000


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the given indices: a four-round Feistel network over
    the next even power of two, walked until it lands inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    out = np.empty_like(x)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = x[todo] >> np.uint64(half), x[todo] & mask
            for r in range(4):
                h = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 4 + r + 1) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
            y = (left << np.uint64(half)) | right
            x[todo] = y
            inside = y < np.uint64(n)
            out[todo[inside]] = y[inside]
            todo = todo[~inside]
    return out.astype(np.int64)


def sized_documents(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """doc_id, source (null where it is no target), tokens and the hash that orders a source."""
    sized = with_tokens(documents, path=path, keep=["doc_id", "source"]).withColumn("source", folded_source(F.col("source")))
    named = targets.select(folded_source(F.col("source")).alias("source")).distinct().withColumn("is_target", F.lit(True))
    return (
        sized.join(F.broadcast(named), "source", "left")
        .withColumn("source", F.when(F.col("is_target"), F.col("source")))
        .drop("is_target")
        .withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
        .withColumn("range", F.shiftrightunsigned(F.col("h"), 64 - int(math.log2(RANGES))).cast("int"))
    )


def _running(df: DataFrame, by: list[str], level: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the exclusive running sum of ``value`` over ``by`` in the order (level, *order)."""
    sums = df.groupBy(*by, level).agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(*by).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, level, F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__base"))
    inner = Window.partitionBy(*by, level).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = df.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return within.join(base, [*by, level]).withColumn(name, F.col("__base") + F.col("__in")).drop("__base", "__in")


def quotas(sized: DataFrame, targets: DataFrame) -> pd.DataFrame:
    """Per target source: tokens and blocks it has, tokens wanted, and its quota of slots."""
    t = targets.select(folded_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").limit(MOST_TARGETS + 1).toPandas()
    if len(t) > MOST_TARGETS:
        raise ValueError("mix targets are expected to be a small table")
    t = t.drop_duplicates("source").sort_values("source", ignore_index=True)
    have = {r["source"]: int(r["n"] or 0) for r in sized.groupBy("source").agg(F.sum(F.col("tokens").cast("long")).alias("n")).collect()}
    total = sum(have.values())
    t["source_no"] = range(len(t))
    t["max_repeats"] = t["max_repeats"].fillna(1).clip(lower=0).astype("int64")
    t["available"] = [have.get(s, 0) for s in t["source"]]
    t["blocks"] = [-(-n // BLOCK_TOKENS) for n in t["available"]]
    t["total"] = total
    t["wanted"] = [round(float(x if x == x else 0.0) * total) for x in t["target_share"].astype(float)]
    t["slots"] = [min(round(w * b / n), b * m) if n else 0 for w, b, n, m in zip(t["wanted"], t["blocks"], t["available"], t["max_repeats"])]
    return t


def spans(sized: DataFrame) -> DataFrame:
    """(doc_id, source, block, first_token, span_tokens, tokens): documents as the spans they have in blocks."""
    docs = sized.where("source is not null and tokens > 0").select("doc_id", "source", F.col("tokens").cast("long").alias("tokens"), "h", "range")
    placed = _running(docs, ["source"], "range", ["h", "doc_id"], "tokens", "begin")
    size = F.lit(BLOCK_TOKENS).cast("long")
    first, last = F.floor(F.col("begin") / size), F.floor((F.col("begin") + F.col("tokens") - 1) / size)
    cut = placed.select("doc_id", "source", "tokens", "begin", F.explode(F.sequence(first, last)).alias("block"))
    lo, hi = F.greatest(F.col("begin"), F.col("block") * size), F.least(F.col("begin") + F.col("tokens"), (F.col("block") + 1) * size)
    return cut.select("doc_id", "source", "block", (lo - F.col("begin")).alias("first_token"), (hi - lo).alias("span_tokens"), "tokens")


def draw(quota: list[int], shard: int, shards: int, shard_slots: int, seed: int) -> np.ndarray:
    """One shard's slots for each source: a multinomial draw over the quotas."""
    total = sum(quota)
    n = shard_slots if shard < shards - 1 else total - shard_slots * (shards - 1)
    return np.random.default_rng([seed, shard]).multinomial(n, np.array(quota, dtype=float) / total)


def shard_slots(spark: SparkSession, plan: pd.DataFrame, seed: int = SEED, size: int = SHARD_SLOTS) -> DataFrame:
    """(source_no, block, shard) of every slot: counts drawn in every shard, stretched to the quotas."""
    quota, blocks = [int(n) for n in plan["slots"]], [int(n) for n in plan["blocks"]]
    total = sum(quota)
    shards = -(-total // size)

    def drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            counts = [draw(quota, int(i), shards, size, seed) for i in f["id"]]
            yield pd.DataFrame({
                "shard": np.repeat(f["id"].to_numpy(), len(quota)),
                "source_no": np.tile(np.arange(len(quota), dtype=np.int32), len(f)),
                "n": np.concatenate(counts).astype(np.int64) if counts else np.empty(0, np.int64),
            })

    counts = spark.range(shards).mapInPandas(drawn, "shard long, source_no int, n long").withColumn("range", F.floor(F.col("shard") / RANGES))
    before = _running(counts, ["source_no"], "range", ["shard"], "n", "before")
    sums = counts.groupBy("source_no").agg(F.sum("n").alias("all_n"))  # a row a target
    named = spark.createDataFrame([(i, q) for i, q in enumerate(quota)], "source_no int, quota long")
    both = before.join(F.broadcast(sums), "source_no").join(F.broadcast(named), "source_no")
    at = lambda n: F.floor(n * F.col("quota") / F.greatest(F.col("all_n"), F.lit(1)))
    last = F.col("shard") == shards - 1
    runs = both.select("source_no", "shard", at(F.col("before")).alias("lo"), F.when(last, F.col("quota")).otherwise(at(F.col("before") + F.col("n"))).alias("hi")).where("hi > lo")

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for no, shard, lo, hi in f.itertuples(index=False):
                place = np.arange(lo, hi, dtype=np.int64)
                out = np.empty_like(place)
                for turn in np.unique(place // blocks[no]):  # every pass has a permutation of its own
                    mine = place // blocks[no] == turn
                    out[mine] = permuted(place[mine] % blocks[no], blocks[no], seed + no * 1_000_003 + int(turn))
                yield pd.DataFrame({"source_no": np.full(len(place), no, np.int32), "block": out, "shard": np.full(len(place), shard, np.int64)})

    # a row is many slots: as many tasks as there are slots to write, not bytes to read
    return runs.repartition(max(1, total // SLOTS_A_TASK), "shard", "source_no").mapInPandas(placed, "source_no int, block long, shard long")


def mix_spans(spark: SparkSession, documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(chosen spans: doc_id, source, block, first_token, span_tokens, tokens, uses, shards, max_repeats; plan)."""
    ensure_checkpoint_dir(spark)
    # numbers only; read several times below, and tokenized once
    sized = sized_documents(documents, targets, path, seed).checkpoint()
    q = quotas(sized, targets)
    plan = spark.createDataFrame(q, "source string, target_share double, max_repeats long, source_no int, available long, blocks long, total long, wanted long, slots long") if len(q) else spark.createDataFrame([], "source string, target_share double, max_repeats long, source_no int, available long, blocks long, total long, wanted long, slots long")
    if not q["slots"].sum():
        empty = spans(sized).where("false").withColumns({"uses": F.lit(0), "shards": F.array(F.lit(0).cast("long")), "max_repeats": F.lit(0).cast("long")})
        return empty, plan
    # as long as max_repeats at most
    used = shard_slots(spark, q, seed).groupBy("source_no", "block").agg(F.count("*").cast("int").alias("uses"), F.array_sort(F.collect_list("shard")).alias("shards"))
    used = used.join(F.broadcast(plan.select("source_no", "source", "max_repeats")), "source_no").drop("source_no")
    return spans(sized).join(used, ["source", "block"]), plan


def mix(spark: SparkSession, documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(chosen records: doc_id, source, tokens, used_tokens, uses (of its most used part), spans, max_repeats; plan)."""
    chosen, plan = mix_spans(spark, documents, targets, path, seed)
    records = chosen.groupBy("doc_id", "source", "tokens", "max_repeats").agg(
        F.sum(F.col("span_tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("uses"), F.count("*").alias("spans")
    )
    return records.select("doc_id", "source", "tokens", "used_tokens", "uses", "spans", "max_repeats"), plan


def share_report(records: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: target and reached share, tokens, records, most uses, and whether it was capped."""
    got = records.groupBy("source").agg(F.sum("used_tokens").alias("used_tokens"), F.count("*").alias("n_records"), F.max("uses").alias("most_uses"))
    joined = plan.join(got, "source", "left").fillna(0, ["used_tokens", "n_records", "most_uses"])
    whole = joined.agg(F.sum("used_tokens").alias("all_used"))
    return joined.join(F.broadcast(whole)).select(
        "source", "target_share", F.col("max_repeats").cast("int").alias("max_repeats"), "available", "wanted", "used_tokens", "n_records", "most_uses",
        F.round(F.col("used_tokens") / F.col("total"), 6).alias("share_of_total"),
        F.round(F.col("used_tokens") / F.greatest("all_used", F.lit(1)), 6).alias("reached_share"),
        (F.col("wanted") > F.col("available") * F.col("max_repeats")).alias("capped"),
    )
