"""Steps of a question-answering run around pluggable models, and reports over finished runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import text as T
from statloom.operators.answers import Completer

# Other names of sub-query types, known types, and chapters that citations may name.
TYPE_ALIASES = {"def": "definition", "exempt": "exemption", "rates": "rate", "proc": "procedure", "penalties": "penalty", "county": "local", "time": "temporal", "stat": "statute"}
TYPES = ("definition", "exemption", "rate", "procedure", "penalty", "local", "temporal", "statute", "general")
KNOWN_CHAPTERS = ("212", "213", "215", "220", "196")
_DECOMPOSED = "struct<sub_queries:array<struct<text:string,type:string,priority:int>>>"


def query_type(c: Column) -> Column:
    """Known type of a query from a free answer; others are general."""
    t = F.trim(F.lower(c))
    aliases = F.create_map(*[F.lit(x) for kv in TYPE_ALIASES.items() for x in kv])
    t = F.coalesce(F.try_element_at(aliases, t), t)
    return F.when(t.isin(*TYPES), t).otherwise("general")


def decompose(queries: DataFrame, complete: Completer) -> DataFrame:
    """(query_id, sub_idx, text, type, priority): queries that need it are split by the model; where
    it is not needed, or the reply is no use, the query stands for itself."""
    asked = queries.withColumn("split", T.needs_splitting(F.col("query")))
    reply = F.when(F.col("split"), complete(F.col("query")))
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    parts = F.from_json(F.when(fenced != "", fenced).otherwise(reply), _DECOMPOSED)["sub_queries"]
    usable = F.filter(F.coalesce(parts, F.array().cast("array<struct<text:string,type:string,priority:int>>")), lambda s: s["text"].isNotNull() & (F.trim(s["text"]) != ""))
    alone = F.array(F.struct(F.col("query").alias("text"), F.lit("general").alias("type"), F.lit(1).alias("priority")))
    out = asked.select("query_id", F.posexplode(F.when(F.size(usable) > 0, usable).otherwise(alone)).alias("sub_idx", "s"))
    return out.select("query_id", "sub_idx", F.col("s.text").alias("text"), query_type(F.col("s.type")).alias("type"), F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce("s.priority", F.lit(1)))).alias("priority"))


def scored_relevance(results: DataFrame, score: Completer) -> DataFrame:
    """Relevance of each result from a model's 0 to 10, as 0 to 1; 0.5 where the reply is no number."""
    n = F.try_to_number(F.regexp_extract(score(F.concat_ws("\n", "query", "text")), r"(\d+(?:\.\d+)?)", 1), F.lit("99.99"))
    return results.withColumn("relevance", F.when(n.isNull(), 0.5).otherwise(F.least(F.lit(1.0), n.cast("double") / 10)))


def embedded(texts: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float]]], key: str, dimension: int, batch: int = 72) -> DataFrame:
    """(key, embedding): vectors from the cache by text hash, the rest made in batches; a batch that
    fails gives zero vectors.  Equal texts are embedded once."""
    hashed = texts.select(key, "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    have = cache.select("hash", "embedding").dropDuplicates(["hash"])
    missing = hashed.select("hash", "text").dropDuplicates(["hash"]).join(have, "hash", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors: list[list[float]] = []
            for i in range(0, len(f), batch):
                part = f["text"].iloc[i : i + batch].fillna("").tolist()
                try:
                    vectors += embed(part)
                except Exception:  # noqa: BLE001 - a failed batch is marked by zero vectors
                    vectors += [[0.0] * dimension] * len(part)
            yield pd.DataFrame({"hash": f["hash"], "embedding": vectors})

    made = missing.mapInPandas(run, "hash string, embedding array<float>")
    return hashed.select(key, "hash").join(have.unionByName(made), "hash").select(key, "embedding")


def doubtful_citations(c: Column) -> Column:
    """Does a citation look made up: no known chapter in it, no rule form, but digits and a point."""
    known = F.exists(F.array(*[F.lit(x) for x in KNOWN_CHAPTERS]), lambda x: F.contains(c, x))
    return ~known & ~F.lower(c).contains("12a") & ~F.lower(c).contains("12-") & c.rlike("[0-9]") & c.contains(".")


def worst(results: DataFrame, n: int = 5) -> DataFrame:
    """The questions with the lowest scores among those not passed or below 7; no score comes first."""
    return results.where(~F.col("passed") | (F.col("score") < 7)).orderBy(F.col("score").asc_nulls_first(), "question_id").limit(n)


#: Fixed value: characters of a preview.
PREVIEW = 200


def side_by_side(methods: dict[str, DataFrame], key: str, top: int = 10, texts: DataFrame | None = None) -> DataFrame:
    """Ranks and rounded scores of several methods in one long table; with ``texts(key, text)`` also
    the beginning of each text, line breaks as blanks."""
    parts = [df.where(F.col("rank") <= top).select(F.lit(n).alias("method"), "query_id", "rank", key, F.round("score", 4).alias("score")) for n, df in methods.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if texts is None:
        return out
    shown = texts.select(key, F.regexp_replace(F.substring("text", 1, PREVIEW), r"\s+", " ").alias("preview"))
    return out.join(shown, key, "left")


def last_by_cluster(cases: DataFrame, key: str, order: str) -> DataFrame:
    """Cases found in several courts once, the last occurrence."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return cases.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def load_verification(expected: DataFrame, actual: DataFrame, label: str) -> DataFrame:
    """Expected against loaded counts by label."""
    j = expected.select(label, F.col("n").alias("expected")).join(actual.select(label, F.col("n").alias("actual")), label, "full")
    e, a = F.coalesce("expected", F.lit(0)), F.coalesce("actual", F.lit(0))
    return j.select(label, e.alias("expected"), a.alias("actual"), (e == a).alias("ok"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts by equal bins; 0 and bins + 1 hold what lies outside."""
    return df.select(F.width_bucket(F.col(value), F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def comparisons(by_category: DataFrame, by_difficulty: DataFrame, gap: float = 0.2) -> DataFrame:
    """(kind, subject, value): the best and the worst category, and a drop from easy to hard questions of
    more than ``gap``; ties by name."""
    known = by_category.where("recall is not null").select(F.col("category").cast("string").alias("subject"), F.col("recall").alias("value"), "category")
    end = lambda kind, order: known.orderBy(order, "category").limit(1).select(F.lit(kind).alias("kind"), "subject", "value")
    rows = end("best_category", F.desc("value")).unionByName(end("worst_category", F.asc("value")))
    of = lambda k: F.max(F.when(F.col("difficulty") == k, F.col("recall")))
    drop = by_difficulty.agg((of("easy") - of("hard")).alias("drop")).where(F.col("drop") > gap)
    return rows.unionByName(drop.select(F.lit("difficulty_drop").alias("kind"), F.lit("hard").alias("subject"), F.round("drop", 6).alias("value")))


def recommendations(by_category: DataFrame, totals: DataFrame) -> DataFrame:
    """(kind, subject, value): what the aggregates call for; human review is always advised."""
    low = by_category.where("recall < 0.70").select(F.lit("expand_corpus").alias("kind"), F.col("category").cast("string").alias("subject"), F.round("recall", 6).alias("value"))
    rules = {"cache_queries": ("latency", F.col("latency") > 5000), "improve_retrieval": ("intervention_rate", F.col("intervention_rate") > 0.3), "strengthen_sources": ("faithfulness", F.col("faithfulness") < 0.85)}
    out = low
    for kind, (column, cond) in rules.items():
        out = out.unionByName(totals.where(cond).select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("subject"), F.round(F.col(column).cast("double"), 6).alias("value")))
    review = totals.limit(1).select(F.lit("human_review").alias("kind"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("double").alias("value"))
    return out.unionByName(review)


def markdown(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """A report of small aggregates (at most ``most`` rows each) as Markdown."""
    lines = [f"# {title}", ""]
    for name, df in tables.items():
        rows = df.limit(most).collect()
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows] + [""]
    return "\n".join(lines)


def html_report(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """The same report as an HTML page."""
    import html

    cell = lambda v: html.escape("" if v is None else str(v))
    out = [f"<!doctype html><html><head><meta charset='utf-8'><title>{cell(title)}</title></head><body><h1>{cell(title)}</h1>"]
    for name, df in tables.items():
        out.append(f"<h2>{cell(name)}</h2><table><tr>" + "".join(f"<th>{cell(c)}</th>" for c in df.columns) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in df.limit(most).collect()]
        out.append("</table>")
    return "\n".join([*out, "</body></html>"])


def json_report(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """The same report as JSON, dates in ISO form."""
    import json

    return json.dumps({"title": title, "tables": {n: [r.asDict(True) for r in df.limit(most).collect()] for n, df in tables.items()}}, default=lambda v: v.isoformat() if hasattr(v, "isoformat") else str(v), ensure_ascii=False)


def error_kind(status: Column) -> Column:
    """Kind of a request's failure by its status."""
    return F.when(status == 429, "rate_limited").when(status == 404, "not_found").when(status == 422, "validation").when(status == 504, "timeout").when(status >= 500, "service").when(status >= 400, "client")


def settings_problems(settings: dict) -> list[str]:
    """What is out of range in a run's settings."""
    ranges = {"alpha": (0.0, 1.0), "temperature": (0.0, 2.0), "top_k": (1, 1000), "max_iterations": (1, 10)}
    return [f"{k} must lie in {lo}..{hi}" for k, (lo, hi) in ranges.items() if k in settings and not lo <= settings[k] <= hi]
