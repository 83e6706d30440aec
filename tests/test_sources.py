import json

import pytest

from statloom.sources import files, pages


def test_json_tree(spark, tmp_path):
    d = tmp_path / "statutes" / "chapter_212"
    d.mkdir(parents=True)
    (d / "a.json").write_text(json.dumps({"metadata": {"section": "212.05", "chapter": "212", "effective_date": "2020-01-02T00:00:00"}, "text": "x", "source_url": "u", "scraped_at": "2024-01-01T10:00:00Z"}))
    (d / "bad.json").write_text("{not json")
    df = files.typed(files.read_raw(spark, str(tmp_path), "statutes"), "2025-01-01 00:00:00")
    r = df.collect()
    assert len(r) == 1 and r[0].metadata.section == "212.05" and str(r[0].metadata.effective_date) == "2020-01-02" and str(r[0].scraped_at) == "2024-01-01 10:00:00"


def test_append_is_idempotent(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    files.append_new(df, p, "id")
    files.append_new(df.union(spark.createDataFrame([(3, "c")], "id int, v string")), p, "id")
    assert sorted(r.id for r in spark.read.parquet(p).collect()) == [1, 2, 3]


def test_upload_counts_missing(spark, tmp_path):
    c = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    v = spark.createDataFrame([("a", [1.0])], "chunk_id string, embedding array<float>")
    assert files.upload(c, v, str(tmp_path / "v"), strict=False) == {"written": 1, "missing": 1}
    with pytest.raises(ValueError, match="no vector for chunk b"):
        files.upload(c, v, str(tmp_path / "v2"))
    assert files.schema_differences(c, ["chunk_id", "x"]) == (["x"], [])


def test_pages_retry_and_cache(spark):
    def fetcher(url):
        if "bad" in url:
            raise OSError("down")
        return f"<p>{url}</p>"

    urls = spark.createDataFrame([("u1",), ("u2",), ("bad",), ("u1",)], "url string")
    got = {r.url: (r.html, r.error) for r in pages.fetch(urls, fetcher, tries=2, parallel=2).collect()}
    assert got["u1"] == ("<p>u1</p>", None) and got["bad"][0] is None and "OSError" in got["bad"][1]
    import hashlib

    cached = spark.createDataFrame([(hashlib.sha256(b"u2").hexdigest(), "old")], "key string, html string")
    rows = {r.url: (r.html, r.from_cache) for r in pages.fetch_missing(urls, cached, fetcher, parallel=2).collect()}
    assert rows["u2"] == ("old", True) and rows["u1"][1] is False


def records(page):
    return [f'{{"n": {page}}}'] * page


def test_paged_source(spark):
    spark.dataSource.register(pages.PagedSource)
    df = spark.read.format("statloom_paged").option("pages", 3).option("reader", "tests.test_sources:records").load()
    assert df.count() == 6


def test_table_admin(spark):
    files.drop_table(spark, "statloom_probe")
    assert files.ensure_table(spark, "statloom_probe", "a int") and not files.ensure_table(spark, "statloom_probe", "a int")
    assert files.table_info(spark, "statloom_probe") == {"columns": ["a"], "rows": 0} and files.drop_table(spark, "statloom_probe")


def following(at):
    n = int(at)
    return [f'{{"n": {n}}}'] * 2, str(n + 1) if n < 5 else None


def test_paged_source_follows_next(spark):
    spark.dataSource.register(pages.PagedSource)
    read = lambda **o: spark.read.format("statloom_paged").options(reader="tests.test_sources:following", **o).load()
    assert read(start="1").count() == 10 and read(start="1", max_rows="3").count() == 3 and read(start="1 4").count() == 14


def test_send_reports_failed_batches(spark):
    def put(rows):
        if any(r["id"] == 7 for r in rows):
            raise OSError("down")

    got = files.send(spark.range(20).coalesce(1), put, batch=5, tries=2).collect()
    assert [r.n for r in got] == [5] * 4 and [r.error is None for r in got] == [True, False, True, True]


def test_json_and_vectors_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    files.write_with_statistics(df, str(tmp_path / "c"), {"statistics": df.groupBy().count()})
    assert sorted((r.id, r.t) for r in files.read_json(spark, str(tmp_path / "c/data"), "id int, t string").collect()) == [(1, "a"), (2, None)]
    assert files.read_json(spark, str(tmp_path / "c/statistics"), "count long").first()[0] == 2
    v = spark.createDataFrame([("a", [1.0, 2.0])], "chunk_id string, embedding array<float>")
    files.write_vectors(v, str(tmp_path / "v"))
    assert files.read_vectors(spark, str(tmp_path / "v"), 2).first().embedding == [1.0, 2.0]
    with pytest.raises(Exception, match="another dimension"):
        files.read_vectors(spark, str(tmp_path / "v"), 3).collect()
    kept = files.without_provenance(files.with_provenance(df, "s", "2024-01-01"))
    assert kept.columns == df.columns


def test_graph_sink(spark, tmp_path):
    v = spark.createDataFrame([("a", "statute"), ("b", "rule")], "id string, doc_type string")
    e = spark.createDataFrame([("a", "b", "cites")], "src string, dst string, relation string")
    files.write_graph(v, e, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "vertices")).where("doc_type = 'rule'").first().id == "b"
    files.clear_graph(spark, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "edges")).count() == 0
