"""Web pages: a batch data source with retries and a pluggable fetcher, and a page cache by key."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetcher = Callable[[str], str | None]


def cache_key(url):
    return F.sha2(url, 256)


def fetch(urls: DataFrame, fetcher: Fetcher, tries: int = 3, wait: float = 0.0, parallel: int = 8) -> DataFrame:
    """(url, html, error) of distinct urls.  ``parallel`` partitions bound the load on the site;
    each waits between its calls and tries again with growing pauses; a failure gives null html."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            html, errors = [], []
            for url in f["url"]:
                got, error = None, None
                for attempt in range(tries):
                    try:
                        got, error = fetcher(url), None
                        break
                    except Exception as e:  # noqa: BLE001 - any failure of a page is recorded
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(wait * 2**attempt)
                html.append(got)
                errors.append(error)
                time.sleep(wait)
            yield pd.DataFrame({"url": f["url"], "html": html, "error": errors})

    return urls.select("url").where("url is not null").distinct().repartition(parallel, "url").mapInPandas(run, "url string, html string, error string")


def fetch_missing(urls: DataFrame, cached: DataFrame, fetcher: Fetcher, **how) -> DataFrame:
    """Pages from the cache where it has them, fetched otherwise."""
    wanted = urls.select("url").distinct().withColumn("key", cache_key(F.col("url")))
    have = cached.select("key", "html").dropDuplicates(["key"])
    hit = wanted.join(have, "key").select("url", "html", F.lit(None).cast("string").alias("error"), F.lit(True).alias("from_cache"))
    miss = fetch(wanted.join(have, "key", "left_anti"), fetcher, **how).withColumn("from_cache", F.lit(False))
    return hit.unionByName(miss)


class PagedSource(DataSource):
    """``spark.read.format("statloom_paged")``: an API that answers page by page.

    Options: ``reader`` (``module:function``), and either ``pages`` (number of pages, each an input
    partition; the function is called with a page number and returns a list of JSON strings) or
    ``start`` (the first page's address; the function is called with an address and returns the
    records and the next address, or none at the end).  An API that only tells the next page can
    only be read in order, so that is one partition; several ``start`` addresses, separated by
    blanks, are read side by side.  ``max_rows`` ends each of them after so many records.
    """

    @classmethod
    def name(cls) -> str:
        return "statloom_paged"

    def schema(self) -> str:
        return "page int, record string"

    def reader(self, schema) -> DataSourceReader:
        most = self.options.get("max_rows") or self.options.get("maxRows")
        if starts := self.options.get("start"):
            return _NextReader(starts.split(), self.options["reader"], int(most) if most else None)
        return _PagedReader(int(self.options.get("pages", "1")), self.options["reader"])


class _NextReader(DataSourceReader):
    """Follows ``next`` from each start."""

    def __init__(self, starts: list[str], target: str, most: int | None):
        self.starts, self.target, self.most = starts, target, most

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in self.starts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from importlib import import_module

        module, function = self.target.split(":")
        get, at, page, n, seen = getattr(import_module(module), function), partition.value, 0, 0, set()
        while at and at not in seen:  # a page that names itself again ends the read
            seen.add(at)
            records, at = get(at)
            page += 1
            for record in records:
                if self.most is not None and n >= self.most:
                    return
                n += 1
                yield page, record


class _PagedReader(DataSourceReader):
    def __init__(self, pages: int, target: str):
        self.pages, self.target = pages, target

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i + 1) for i in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from importlib import import_module

        module, function = self.target.split(":")
        for record in getattr(import_module(module), function)(partition.value):
            yield partition.value, record
