import duckdb
import pytest

from statloom.llm.queries import QUERIES, SQL

COLUMNS = {"p1_found": {"src_table", "raw_id"}, "p3_found": {"raw_id"}, "p5_found": {"chunk_id"}, "p8_found": {"doc_id"}}


@pytest.mark.parametrize("name", list(QUERIES))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name in COLUMNS:
        assert set(df.columns) == COLUMNS[name] and len({tuple(r) for r in rows}) == len(rows)
    if name in SQL:
        con = duckdb.connect()
        for t in ("legal_chunks", "size_limits", "documents", "mix_targets", "graph_chunks"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
        r = con.execute(SQL[name])
        at = [[c[0] for c in r.description].index(c) for c in df.columns]
        assert sorted(repr([x[i] for i in at]) for x in r.fetchall()) == sorted(repr(list(x)) for x in rows)
