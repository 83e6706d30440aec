"""Audits of raw records, maps of counts, JSON rows, and the tables behind a report's charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import text as T

#: Fixed value: texts below this length are reported.
SHORT = 50


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def audit(rows: DataFrame, kind: str, key: Column, order: Column, required: dict[str, Column], text: Column, more: dict[str, Column] | None = None) -> DataFrame:
    """(kind, issue, n): duplicate keys (all but the first), missing required fields, short texts,
    encoding flags, and further conditions by name.  Null keys are keys like any other."""
    dup = F.row_number().over(Window.partitionBy(key).orderBy(order)) > 1
    flags = F.filter(F.split(T.encoding_flags(F.coalesce(text, F.lit(""))), ","), lambda x: x != "")
    named = [F.when(blank(c), F.lit(f"missing_field:{n}")) for n, c in required.items()] + [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in (more or {}).items()]
    issues = F.concat(
        F.array_compact(F.array(F.when(F.col("__dup"), F.lit("duplicate_id")), F.when(F.length(F.coalesce(text, F.lit(""))) < SHORT, F.lit("empty_or_short_text")), *named)),
        F.transform(flags, lambda x: F.concat(F.lit("encoding:"), x)),
    )
    return rows.withColumn("__dup", dup).select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "issue", "n")


def audit_taas(raw: DataFrame) -> DataFrame:
    m = lambda n: F.col(f"metadata.{n}")
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    key = F.regexp_replace(F.coalesce(m("taa_number"), F.lit("")), " ", "_")
    return audit(raw, "taa", key, F.col("raw_id"), {"taa_number": m("taa_number"), "title": m("title")}, F.col("text"), {"no_statutes_cited": none(m("statutes_cited")), "no_rules_cited": none(m("rules_cited"))})


def audit_documents(documents: DataFrame, kind: str) -> DataFrame:
    """Rules and cases, from the unified documents."""
    rows = documents.where(F.col("doc_type") == kind)
    more = {"no_date": F.col("effective_date").isNull(), "no_statutes_cited": F.size("cites_statutes") <= 0, "no_cases_cited": F.size("cites_cases") <= 0}
    return audit(rows, kind, F.col("id"), F.struct("scraped_at", F.xxhash64("text")), {"title": F.col("title"), "full_citation": F.col("full_citation"), "source_url": F.col("source_url")}, F.col("text"), more)


def audit_totals(*audits: DataFrame) -> DataFrame:
    """Issues over all kinds, with a row for each kind's sum (null issue) and one for all (null kind)."""
    out = audits[0]
    for a in audits[1:]:
        out = out.unionByName(a)
    return out.rollup("kind", "issue").agg(F.sum("n").alias("n"))


def count_map(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """Counts of each value of ``key`` as a map (null as ``none``); one entry a value."""
    per = df.groupBy(*by, F.coalesce(F.col(key).cast("string"), F.lit("none")).alias("__k")).agg(F.count("*").alias("__n"))
    return per.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", "__n")))).alias("counts"))


def sum_maps(df: DataFrame, by: list[str], counts: str = "counts") -> DataFrame:
    """The sums of several maps of counts."""
    per = df.select(*by, F.explode(counts).alias("__k", "__n")).groupBy(*by, "__k").agg(F.sum("__n").alias("__n"))
    return per.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", "__n")))).alias("counts"))


def map_text(c: Column) -> Column:
    """A map as ``key=value`` pairs in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


def json_rows(df: DataFrame, columns: list[str]) -> Column:
    """A row as JSON with ISO dates and times; nulls are written."""
    return F.to_json(F.struct(*columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "dateFormat": "yyyy-MM-dd", "ignoreNullFields": "false"})


def citation_of(doc_id: Column) -> Column:
    """The citation that a document id names: what follows its first colon, else the id."""
    at = F.locate(":", doc_id)
    return F.when(at > 0, F.substring(doc_id, at + 1, F.length(doc_id))).otherwise(doc_id)


def issues_by_type(events: DataFrame, types: str = "types", severities: str = "severities") -> DataFrame:
    """One row a kind of issue: how many, mean and greatest severity (the lists run in parallel)."""
    each = events.select(F.explode(F.arrays_zip(F.col(types).alias("t"), F.col(severities).alias("s"))).alias("x")).select(F.coalesce("x.t", F.lit("unknown")).alias("issue_type"), "x.s")
    return each.groupBy("issue_type").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("avg_severity"), F.max("s").alias("max_severity"))


def funnel(events: DataFrame) -> DataFrame:
    """(position, stage, n): all queries, clean, with issues, corrected, regenerated, left unresolved."""
    a = F.col("action")
    stages = [("total", F.lit(True)), ("clean", a == "none"), ("with_issues", a != "none"), ("corrected", a == "corrected"), ("regenerated", a == "regenerated"), ("unresolved", a == "failed")]
    row = events.agg(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("stage"), F.count_if(c).alias("n")) for i, (n, c) in enumerate(stages)]).alias("s"))
    return row.select(F.inline("s"))


def precision_recall_curve(results: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """Mean precision and recall at each cut-off, from one pass over the results of all queries."""
    n = relevant.groupBy("query_id").agg(F.countDistinct("item").alias("n_relevant"))
    marked = results.join(relevant.select("query_id", "item").distinct().withColumn("hit", F.lit(1)), ["query_id", "item"], "left")
    at = marked.select("query_id", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("rank"))).alias("k"), F.coalesce("hit", F.lit(0)).alias("hit"))
    per = at.groupBy("query_id", "k").agg(F.sum("hit").alias("hits"), F.count("*").alias("shown")).join(n, "query_id")
    return per.groupBy("k").agg(F.round(F.avg(F.col("hits") / F.col("shown")), 6).alias("precision"), F.round(F.avg(F.col("hits") / F.col("n_relevant")), 6).alias("recall"))


def score_histogram(df: DataFrame, score: str, bins: int = 10) -> DataFrame:
    """Counts of scores in 0..1 by equal bins (1 belongs to the last), with zeros for empty ones."""
    of = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(df.groupBy(of.alias("bin")).agg(F.count("*").alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
