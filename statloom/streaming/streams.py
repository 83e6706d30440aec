"""Structured Streaming: limiter, cache, running metrics, deduplicated appends, stage logs.

The sequential rules match their batch versions in ``operators.observe``; rows later than the
watermark are dropped by Spark, which is the stated policy for late data.  State per key is bounded
(the last passed times, or one time) and is removed once the watermark is past what it can matter for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_events(spark: SparkSession, folder: str, schema, name: str = "events.parquet", per_trigger: int = 1) -> DataFrame:
    """The event files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def limited(events: DataFrame, key: str, ts: str, limit: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """Sliding-window limiter per key: (key, event_id, passed); the state holds at most ``limit``
    times of passed requests."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        f = pd.concat(list(frames))  # one key's rows of one micro-batch
        f = f.sort_values([ts, "event_id"])
        passed = list(state.get[0]) if state.exists else []
        out = []
        for t in f[ts]:
            us = int(t.value // 1000)
            passed = [x for x in passed if x > us - seconds * 1_000_000]
            ok = len(passed) < limit
            if ok:
                passed.append(us)
            out.append(ok)
        state.update((passed,))
        state.setTimeoutTimestamp(int(f[ts].iloc[-1].value // 1_000_000) + seconds * 1000)
        yield pd.DataFrame({key: k[0], "event_id": f["event_id"].to_numpy(), "passed": out})

    out = f"{key} {events.schema[key].dataType.simpleString()}, event_id long, passed boolean"
    return events.withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, out, "passed array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def cached(events: DataFrame, key: str, ts: str, ttl_seconds: int, late: str = "1 hour") -> DataFrame:
    """Cache per key: (key, event_id, hit); a hit does not prolong an entry's life."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        f = pd.concat(list(frames)).sort_values([ts, "event_id"])
        at = state.get[0] if state.exists else None
        out = []
        for t in f[ts]:
            us = int(t.value // 1000)
            hit = at is not None and us - at < ttl_seconds * 1_000_000
            if not hit:
                at = us
            out.append(hit)
        state.update((at,))
        state.setTimeoutTimestamp(int(f[ts].iloc[-1].value // 1_000_000) + ttl_seconds * 1000)
        yield pd.DataFrame({key: k[0], "event_id": f["event_id"].to_numpy(), "hit": out})

    out = f"{key} {events.schema[key].dataType.simpleString()}, event_id long, hit boolean"
    return events.withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, out, "inserted long", "append", GroupStateTimeout.EventTimeTimeout)


def running_metrics(events: DataFrame, ts: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts, errors and mean latency by window and type under a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg"))


def once(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Reads what there is, writes it exactly once, and ends; a restart goes on where it stopped."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()


def stage_events(batch: DataFrame, stages: list[str] | None = None, text: str | None = None) -> DataFrame:
    """The ordered events of each request, from a batch or a stream: one row per stage (``stages``, or
    those of the array column ``stages``), then ``complete``; with ``text`` the column's beginning
    comes with the last one."""
    names = F.array(*[F.lit(s) for s in stages]) if stages is not None else F.coalesce("stages", F.array().cast("array<string>"))
    shown = F.substring(F.coalesce(F.col(text), F.lit("")), 1, SHOWN) if text else F.lit(None).cast("string")
    events = F.concat(F.transform(names, lambda s: F.struct(s.alias("event"), F.lit(None).cast("string").alias("data"))), F.array(F.struct(F.lit("complete").alias("event"), shown.alias("data"))))
    return batch.select("request_id", F.posexplode(events).alias("seq", "e")).select("request_id", "seq", "e.event", "e.data")


#: Characters of an answer that its last event shows.
SHOWN = 500
