"""Latency, errors, stages, rates, caches and limits over event logs."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Value ranges that an exact selection cuts each group into.
RANGES = 256


def percentile_at(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The value at index ``int(n x p)`` of the sorted values (n - 1 at most), per group; exact."""
    return values_at(df, by, value, {name: F.least(F.floor(F.col("n") * p), F.col("n") - 1) for name, p in shares.items()}).drop("n")


def values_at(df: DataFrame, by: list[str], value: str, indices: dict[str, Column]) -> DataFrame:
    """The values at indices (columns over ``n``, the group's size) of the sorted values, and ``n``.

    Selection instead of sorting a group: equal values are counted map-side, approximate quantiles
    cut each group into ranges, the ranges' counts tell which one holds an index, and only those
    ranges are ordered.  So a group may be most of the data without being one task's work.  Null
    values do not count; rows with a null group key form a group of their own.
    """
    same = lambda l, r, cols: [F.col(f"{l}.{c}").eqNullSafe(F.col(f"{r}.{c}")) for c in cols]
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    cuts = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    groups = counts.groupBy(*by).agg(F.percentile_approx(value, cuts).alias("cuts"), F.sum("c").alias("n"))
    marked = counts.alias("a").join(groups.alias("g"), same("a", "g", by)).select(
        *[f"a.{c}" for c in by], f"a.{value}", "c", "n", F.size(F.filter("cuts", lambda x: x < F.col(f"a.{value}"))).alias("range")
    )
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows a group
    ranges = marked.groupBy(*by, "range").agg(F.sum("c").alias("in_range"), F.first("n").alias("n")).withColumn("start", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
    at = F.array(*[F.struct(F.lit(name).alias("name"), i.cast("long").alias("i")) for name, i in indices.items()])
    wanted = ranges.select(*by, "range", "start", "in_range", "n", F.inline(at)).where("i >= start and i < start + in_range")
    cols = [*by, "range"]
    near = marked.alias("a").join(wanted.alias("w"), same("a", "w", cols)).select(*[f"a.{c}" for c in cols], f"a.{value}", "c", "name", "i", "start", "w.n")
    upto = F.col("start") + F.sum("c").over(Window.partitionBy(*cols, "name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    found = near.withColumn("upto", upto).where("i < upto and i >= upto - c")
    return found.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in indices])


def latency_summary(df: DataFrame, by: list[str], value: str, failed: Column) -> DataFrame:
    n = F.count("*")
    return df.groupBy(*by).agg(
        n.alias("n"), F.round(F.avg(value), 2).alias("avg"), F.round(F.min(value), 2).alias("min"), F.round(F.max(value), 2).alias("max"),
        F.round(F.count_if(~failed) * 100 / n, 2).alias("success_pct"),
    )


def interpolated(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles between the two values next to ``p x (n - 1)``, by the selection of :func:`values_at`."""
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    found = values_at(df, by, value, {f"{side}_{name}": f(place(p)) for name, p in shares.items() for side, f in (("lo", F.floor), ("hi", F.ceil))})
    between = lambda name, p: F.col(f"lo_{name}") + (F.col(f"hi_{name}") - F.col(f"lo_{name}")) * (place(p) - F.floor(place(p)))
    return found.select(*by, *[F.round(between(name, p), 6).alias(name) for name, p in shares.items()])


def stage_profile(df: DataFrame, request: str, stage: str, ms: str, order: str) -> DataFrame:
    """Per request and stage: summed time and when the stage was first seen."""
    return df.groupBy(request, stage).agg(F.round(F.sum(ms), 6).alias("total"), F.min(order).alias("first_seen"), F.count("*").alias("n"))


def stage_averages(df: DataFrame, stages: str) -> DataFrame:
    """Mean, number and share of the time of each stage, from one map (stage to milliseconds) a request."""
    each = df.select(F.explode(stages).alias("stage", "ms"))
    per = each.groupBy("stage").agg(F.round(F.avg("ms"), 6).alias("avg"), F.count("*").alias("n"), F.sum("ms").alias("total"))
    return per.select("stage", "avg", "n", F.round(F.col("total") / F.sum("total").over(Window.partitionBy()), 6).alias("share"))  # a row a stage


def window_counts(df: DataFrame, key: str, ts: str, seconds: int, spans: int = 24) -> DataFrame:
    """Requests of a key in the seconds up to each one (all requests count).

    A key's history is cut into stretches of ``spans`` windows; the rows that the next stretch still
    looks back on are given to it as well, so a busy key is spread over as many tasks as stretches.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    width, back = spans * seconds * 1_000_000, seconds * 1_000_000
    own = F.floor(us / width).cast("long")
    placed = df.withColumn("__us", us).withColumn("__own", own)
    seen_by = F.array_compact(F.array(F.col("__own"), F.when(F.col("__us") >= (F.col("__own") + 1) * width - back, F.col("__own") + 1)))
    rows = placed.withColumn("__at", F.explode(seen_by))
    w = Window.partitionBy(key, "__at").orderBy("__us").rangeBetween(-back, 0)
    return rows.withColumn("in_window", F.count("*").over(w)).where("__at = __own").drop("__us", "__own", "__at")


def hit_rate(hits: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(hits / total)


#: Windows of a stretch in which a key's rows are looked at for pauses.
STRETCH = 24


def pauses(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Adds ``__run``: the rows of a key between two pauses of at least ``seconds``.

    What a sequential rule with that memory knows is void after such a pause, so runs are independent
    of one another.  Only pauses between stretches of time count (fewer runs, same results): the
    first and last times of each stretch are aggregated, and only those are ordered by key.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    of = df.withColumn("__us", us).withColumn("__stretch", F.floor(F.col("__us") / (STRETCH * seconds * 1_000_000)))
    ends = of.groupBy(key, "__stretch").agg(F.min("__us").alias("lo"), F.max("__us").alias("hi"))
    w = Window.partitionBy(key).orderBy("__stretch")
    starts = F.when(F.col("lo") - F.lag("hi").over(w) >= seconds * 1_000_000, 1).otherwise(0)
    runs = ends.withColumn("new", starts).withColumn("__run", F.sum("new").over(w)).select(F.col(key).alias("__key"), F.col("__stretch").alias("__of"), "__run")
    on = F.col(key).eqNullSafe(F.col("__key")) & F.col("__stretch").eqNullSafe(F.col("__of"))
    return of.join(runs, on).drop("__us", "__stretch", "__key", "__of")


def _fold(df: DataFrame, key: str, ts: str, seconds: int, order: list[str], start: Callable[[], object], step: Callable[[object, pd.Timestamp], bool], name: str) -> DataFrame:
    """A sequential rule per key, streamed: rows come sorted by key and run (:func:`pauses`), only the
    state of the run at hand is kept, and no group is ever held in memory.  Null keys are one key."""
    from pyspark.sql.types import BooleanType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(name, BooleanType())])
    run_of = F.to_json(F.struct(F.col(key), F.col("__run")), {"ignoreNullFields": "false"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, start()
        for f in frames:
            out = []
            for of, t in zip(f["__run"], f[ts]):
                if of != at:
                    at, state = of, start()
                out.append(step(state, t))
            f = f.drop(columns="__run")
            f[name] = out
            yield f

    runs = pauses(df, key, ts, seconds).withColumn("__run", run_of).select(*df.columns, "__run")
    return runs.repartition("__run").sortWithinPartitions("__run", *order).mapInPandas(run, schema)


def limited(df: DataFrame, key: str, ts: str, limit: int, seconds: int, order: list[str]) -> DataFrame:
    """Sliding-window limiter: a request passes if fewer than ``limit`` passed requests of its key lie
    within the last ``seconds``; rejected requests are not recorded.  State: at most ``limit`` times."""
    window = pd.Timedelta(seconds=seconds)

    def step(passed: deque, t: pd.Timestamp) -> bool:
        while passed and passed[0] <= t - window:
            passed.popleft()
        if len(passed) < limit:
            passed.append(t)
            return True
        return False

    return _fold(df, key, ts, seconds, order, deque, step, "passed")


def cached(df: DataFrame, key: str, ts: str, ttl_seconds: int, order: list[str]) -> DataFrame:
    """Result cache with a time to live: a hit within the time of the insert; a hit does not prolong
    it, and a miss inserts anew.  State: one time per key at hand."""
    ttl = pd.Timedelta(seconds=ttl_seconds)

    def step(at: list, t: pd.Timestamp) -> bool:
        hit = bool(at) and t - at[0] < ttl
        if not hit:
            at[:] = [t]
        return hit

    return _fold(df, key, ts, ttl_seconds, order, list, step, "hit")


def cache_key(query: Column, filters: Column | None = None) -> Column:
    """Key of a result cache: the query in lower case, blanks folded, with its filters, hashed."""
    plain = F.trim(F.regexp_replace(F.lower(query), r"\s+", " "))
    return F.sha2(plain if filters is None else F.concat_ws("|", plain, filters), 256)


def cacheable(answer: Column, confidence: Column, least: float = 0.3) -> Column:
    """May an answer be kept: not empty, no refusal, and of some confidence (a missing one counts 0)?"""
    text = F.trim(F.coalesce(answer, F.lit("")))
    return (text != "") & ~text.startswith("Unable") & (F.coalesce(confidence, F.lit(0.0)) >= least)


def load_summary(df: DataFrame, by: list[str], ts: str, status: Column, failed: Column) -> DataFrame:
    """Load test: requests, requests a second over the time from first to last, success rate, and the
    counts of each status as a map."""
    per = df.withColumn("__status", status.cast("string")).withColumn("__failed", failed)
    of_status = per.groupBy(*by, "__status").agg(F.count("*").alias("c"), F.count_if("__failed").alias("f"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    seconds = F.greatest((F.unix_micros(F.max("hi").cast("timestamp")) - F.unix_micros(F.min("lo").cast("timestamp"))) / 1e6, F.lit(1.0))
    known = F.collect_list(F.struct(F.coalesce("__status", F.lit("none")).alias("k"), F.col("c").alias("v")))  # one a status
    return of_status.groupBy(*by).agg(
        F.sum("c").alias("n"), F.round(F.sum("c") / seconds, 6).alias("per_second"), F.round(1 - F.sum("f") / F.sum("c"), 6).alias("success_rate"), F.map_from_entries(F.array_sort(known)).alias("by_status"),
    )


def errors_by_kind(df: DataFrame, by: list[str], kind: Column, failed: Column) -> DataFrame:
    """Failed requests by kind of error and their share of all failures of the group."""
    per = df.where(failed).groupBy(*by, kind.alias("error")).agg(F.count("*").alias("n"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 6))


def compare(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Change of a summary between two runs, in absolute and relative terms."""
    j = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full")
    return j.withColumn("delta", F.round(F.col("after") - F.col("before"), 6)).withColumn("pct", F.round((F.col("after") - F.col("before")) * 100 / F.col("before"), 4))


def health(checks: DataFrame) -> DataFrame:
    """healthy if all checks pass, degraded if some do, else unhealthy."""
    g = checks.agg(F.bool_and("ok").alias("all_ok"), F.bool_or("ok").alias("some_ok"))
    return g.select(F.when(F.coalesce("all_ok", F.lit(False)), "healthy").when(F.col("some_ok"), "degraded").otherwise("unhealthy").alias("status"))
