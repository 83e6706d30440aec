from statloom.operators import observe
from statloom.queries import plans


def test_stream_matches_batch(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts")
    batch = {r.event_id: r.passed for r in observe.limited(ev, "user_id", "ts", 3, 21600, ["ts", "event_id"]).collect()}
    assert {r.event_id: r.passed for r in plans.stream_limiter(spark, sf).collect()} == batch
    hits = {r.event_id: r.hit for r in observe.cached(ev, "user_id", "ts", 21600, ["ts", "event_id"]).collect()}
    assert {r.event_id: r.hit for r in plans.stream_cache(spark, sf).collect()} == hits
    assert sum(r.n for r in plans.stream_once(spark, sf).collect()) == ev.count()
