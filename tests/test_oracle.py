"""Every registered core query against its SQL on the smallest data; the rest must run."""

import math
from pathlib import Path

import duckdb
import pytest

from statloom.queries import all_queries, all_sql

SLOW = {"stream_limiter", "stream_cache", "stream_once"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", [n for n in all_queries() if n not in SLOW])
def test_query_matches_sql(spark, sf, con, name):
    df = all_queries()[name](spark, sf)
    rows = df.collect()
    if name not in all_sql():
        assert df.columns
        return
    r = con.execute(all_sql()[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    theirs = sorted(repr(tuple(plain(x[cols.index(c)]) for c in order)) for x in r.fetchall())
    ours = sorted(repr(tuple(plain(x[c]) for c in order)) for x in rows)
    assert ours == theirs


def test_every_sql_has_a_query():
    assert set(all_sql()) <= set(all_queries())
