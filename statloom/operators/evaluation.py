"""Ranking, authority, citation, faithfulness and correction metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import text as T

# Authority weights, hierarchy, verdict weights, severity bins, score classes.
AUTHORITY = {"statute": 3.0, "rule": 2.0, "case": 2.0, "taa": 1.0}
HIERARCHY = ("statute", "rule", "case", "taa")
VERDICT = {"supported": 1.0, "partial": 0.5, "contradicted": -0.5, "not_supported": 0.0}


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def ranking_metrics(results: DataFrame, relevant: DataFrame, k: int, dedupe: bool = False) -> DataFrame:
    """Per query of ``relevant(query_id, item)``: reciprocal rank, NDCG, recall and precision at k of
    ``results(query_id, rank, item)``.  No relevant item: recall 1, the rest 0.  NDCG's ideal counts
    the relevant items, so repeated items may take it above 1 unless ``dedupe``."""
    if dedupe:
        w = Window.partitionBy("query_id", "item").orderBy("rank")
        results = results.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    n = relevant.groupBy("query_id").agg(F.countDistinct("item").alias("n_relevant"))
    marked = results.join(relevant.select("query_id", "item").distinct().withColumn("hit", F.lit(True)), ["query_id", "item"], "left")
    top = F.col("rank") <= k
    hit = F.coalesce("hit", F.lit(False))
    per = marked.groupBy("query_id").agg(
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum(F.when(hit & top, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.countDistinct(F.when(hit & top, F.col("item"))).alias("found"),
        F.count_if(hit & top).alias("hits"),
        F.count_if(top).alias("shown"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n_relevant", F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    j = n.join(per, "query_id", "left")
    return j.select(
        "query_id",
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.col("found") / F.col("n_relevant"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.when(F.col("shown") > 0, F.col("hits") / F.col("shown")), F.lit(0.0)).alias("precision"),
    )


def averages(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    cols = ["rr", "ndcg", "recall", "precision"]
    g = metrics.groupBy(*by) if by else metrics.groupBy()
    return g.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in cols])


def best_of(table: DataFrame, name: str, score: str, order: str) -> DataFrame:
    """The row of the highest score, the first in ``order`` on ties."""
    return table.agg(F.max_by(name, F.struct(F.col(score), -F.col(order))).alias(f"best_{name}"), F.max(score).alias(f"best_{score}"))


def best_method(results: DataFrame, relevant: Column, order: list[str]) -> DataFrame:
    """Per query the method of the highest reciprocal rank, the first in ``order`` on ties."""
    per = results.groupBy("query_id", "method").agg(F.coalesce(1 / F.min(F.when(F.coalesce(relevant, F.lit(False)), F.col("rank"))), F.lit(0.0)).alias("rr"))
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method"))
    best = per.groupBy("query_id").agg(F.max_by("method", F.struct("rr", -place)).alias("best_method"), F.max("rr").alias("best_rr"))
    return best.select("query_id", "best_method", F.round("best_rr", 6).alias("best_rr"))


def authority_weight(kind: Column) -> Column:
    out = F.lit(0.5)
    for k, w in AUTHORITY.items():
        out = F.when(F.lower(kind) == k, w).otherwise(out)
    return out


def hierarchy_rank(kind: Column) -> Column:
    out = F.lit(len(HIERARCHY))
    for i, k in enumerate(HIERARCHY):
        out = F.when(F.lower(kind) == k, i).otherwise(out)
    return out


def authority_metrics(results: DataFrame, k: int = 10) -> DataFrame:
    """Per query: authority NDCG (the ideal sorts all results, then cuts at k), alignment with the
    hierarchy (share of ordered pairs of the first k; 1 below two), and share of primary sources."""
    w = authority_weight(F.col("doc_type"))
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(w.desc(), "rank"))
    rows = results.select("query_id", "rank", "doc_type", w.alias("w"), ideal.alias("ideal"), hierarchy_rank(F.col("doc_type")).alias("h"))
    top = F.col("rank") <= k
    per = rows.groupBy("query_id").agg(
        F.sum(F.when(top, F.col("w") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("ideal") <= k, F.col("w") / F.log2(F.col("ideal") + 1)).otherwise(0.0)).alias("idcg"),
        F.avg(F.when(top, F.lower("doc_type").isin("statute", "rule").cast("double"))).alias("primary"),
        F.transform(F.array_sort(F.collect_list(F.when(top, F.struct("rank", "h")))), lambda s: s["h"]).alias("hs"),  # at most k entries
    )
    pairs = F.expr("aggregate(sequence(1, greatest(size(hs), 1)), 0L, (a, i) -> a + CAST(size(filter(slice(hs, i, size(hs)), h -> h >= element_at(hs, i))) - 1 AS BIGINT))")
    n = F.size("hs")
    return per.select(
        "query_id",
        F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0), 6).alias("authority_ndcg"),
        F.round(F.when(n < 2, 1.0).otherwise(pairs / (n * (n - 1) / 2)), 6).alias("alignment"),
        F.round("primary", 6).alias("primary_rate"),
    )


def authority_report(metrics: DataFrame, results: DataFrame) -> DataFrame:
    """One row over all queries: mean authority metrics, and how many results there are of each kind."""
    means = metrics.agg(*[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("authority_ndcg", "alignment", "primary_rate")])
    kinds = results.agg(*[F.count_if(F.lower("doc_type") == k).alias(f"n_{k}") for k in HIERARCHY], F.count_if(~F.coalesce(F.lower("doc_type").isin(*HIERARCHY), F.lit(False))).alias("n_other"))
    return means.join(kinds)  # one row each


def kinds_by_rank(results: DataFrame, ranks: int = 5) -> DataFrame:
    """Rank x kind table with zeros for absent cells of the four kinds."""
    return results.where(F.col("rank") <= ranks).groupBy("rank").pivot("doc_type", list(HIERARCHY)).count().fillna(0, list(HIERARCHY))


def matched_citations(generated: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, generated, expected) pairs that match, without comparing all with all: equal bases, or
    an equal stem before the first parenthesis with one a prefix of the other."""
    g = generated.select(key, F.col("c").alias("generated"), T.normal_citation(F.col("c")).alias("gn"), T.base_citation(F.col("c")).alias("gb"))
    e = expected.select(key, F.col("c").alias("expected"), T.normal_citation(F.col("c")).alias("en"), T.base_citation(F.col("c")).alias("eb"))
    same = g.join(e, [g[key] == e[key], g["gb"] == e["eb"]]).select(g[key], "generated", "expected")
    stem = lambda c: F.substring_index(c, "(", 1)
    longer = g.join(e, [g[key] == e[key], stem(g["gn"]) == stem(e["en"])]).where("startswith(gn, en) and substring(gn, length(en) + 1, 1) = '('").select(g[key], "generated", "expected")
    return same.union(longer).distinct()


def citation_scores(generated: DataFrame, expected: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Precision (1 without generated or expected), recall (1 without expected) and F1 per key."""
    pairs = matched_citations(generated, expected, key)
    ng = generated.groupBy(key).agg(F.countDistinct("c").alias("n_generated"))
    ne = expected.groupBy(key).agg(F.countDistinct("c").alias("n_expected"))
    m = pairs.groupBy(key).agg(F.countDistinct("generated").alias("ok_generated"), F.countDistinct("expected").alias("ok_expected"))
    j = keys.join(ng, key, "left").join(ne, key, "left").join(m, key, "left").fillna(0)
    p = F.when((F.col("n_generated") == 0) | (F.col("n_expected") == 0), 1.0).otherwise(F.col("ok_generated") / F.col("n_generated"))
    r = F.when(F.col("n_expected") == 0, 1.0).otherwise(F.col("ok_expected") / F.col("n_expected"))
    return j.select(key, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def faithfulness(claims: DataFrame, by: str) -> DataFrame:
    """Verdict counts and the clamped weighted score; 1 without claims is left to the caller's join."""
    v = F.col("verdict")
    weight = F.lit(0.0)
    for name, w in VERDICT.items():
        weight = F.when(v == name, w).otherwise(weight)
    g = claims.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(v == k).alias(k) for k in VERDICT], F.sum(weight).alias("s"))
    return g.select(by, "n", *VERDICT, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s") / F.col("n"))), 6).alias("score"))


def severity_bin(s: Column) -> Column:
    return F.when(s < 0.3, "low").when(s < 0.5, "medium").when(s < 0.7, "high").otherwise("critical")


def correction_action(passed: Column, corrected: Column, attempts: Column) -> Column:
    """Corrections are recognised first, then regenerations, so that both can be counted."""
    return F.when(corrected > 0, "corrected").when(attempts > 0, "regenerated").when(passed, "none").otherwise("failed")


def correction_metrics(events: DataFrame) -> DataFrame:
    """One row from events(action, issues, corrected, delta): counts, rates, mean confidence change
    of the queries that were acted on."""
    acted = F.col("action") != "none"
    n = F.count("*")
    g = events.agg(
        n.alias("n_queries"),
        F.count_if(F.col("issues") > 0).alias("n_with_issues"),
        *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("corrected", "regenerated", "failed")],
        F.coalesce(F.sum("issues"), F.lit(0)).alias("n_issues"),
        F.coalesce(F.sum("corrected"), F.lit(0)).alias("n_corrections"),
        F.count_if(acted).alias("n_acted"),
        F.round(F.avg(F.when(acted, F.col("delta"))), 6).alias("avg_delta"),
    )
    one = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)
    return g.select(
        "*",
        one("n_acted", "n_queries").alias("intervention_rate"),
        one("n_regenerated", "n_queries").alias("regeneration_rate"),
        F.when(F.col("n_issues") == 0, 1.0).otherwise(one("n_corrections", "n_issues")).alias("success_rate"),
    )


def ablation(summary: DataFrame) -> DataFrame:
    """Differences between the runs without and with validation of a two-row summary."""
    p = summary.groupBy().agg(*[F.max(F.when(F.col("validated") == v, F.col(c))).alias(f"{c}_{n}") for v, n in ((True, "with"), (False, "without")) for c in ("errors", "score")])
    return p.select(
        "*", (F.col("errors_without") - F.col("errors_with")).alias("errors_delta"), F.round(F.col("score_with") - F.col("score_without"), 6).alias("score_delta"),
        F.greatest(F.lit(0), F.col("errors_without") - F.col("errors_with")).alias("errors_prevented"),
    )


def score_class(v: Column) -> Column:
    return F.when(v >= 0.9, "success").when(v >= 0.7, "warning").otherwise("danger")


def confidence_label(v: Column) -> Column:
    return F.when(v >= 0.8, "High").when(v >= 0.5, "Medium").otherwise("Low")


def validation_decision(results: DataFrame) -> DataFrame:
    """regenerate, correct or accept from the worst and mean severity and the accuracy."""
    worst, mean, acc = F.coalesce("worst", F.lit(0.0)), F.coalesce("mean", F.lit(0.0)), F.col("accuracy")
    out = F.when((worst >= 0.9) | (mean >= 0.7) | (acc < 0.5), "regenerate").when((mean >= 0.3) | (acc < 0.8), "correct").otherwise("accept")
    return results.withColumn("decision", out)


def answer_confidence(sources: DataFrame, cited: DataFrame, key: str) -> DataFrame:
    """0.6 x mean kind weight of the first five sources + 0.4 x share of verified citations (0.5
    without citations), within 0..1."""
    w = F.lit(0.5)
    for k, v in {"statute": 1.0, "rule": 0.9, "case": 0.7, "taa": 0.6}.items():
        w = F.when(F.col("doc_type") == k, v).otherwise(w)
    s = sources.where("rank <= 5").groupBy(key).agg(F.avg(w).alias("quality"))
    c = cited.groupBy(key).agg(F.avg(F.col("verified").cast("double")).alias("verified"))
    x = F.col("quality") * 0.6 + F.coalesce("verified", F.lit(0.5)) * 0.4
    return s.join(c, key, "left").select(key, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)), 6).alias("confidence"))
