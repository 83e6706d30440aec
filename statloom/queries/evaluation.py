"""Queries of evaluation and observability with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import text as T
from statloom.operators import evaluation as E
from statloom.operators import observe as O
from statloom.operators import retrieval as R
from statloom.queries.retrieval import _bm25, _results, _vec, _vsql
from statloom.session import table


def _ranked(spark, d) -> tuple[DataFrame, DataFrame]:
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    results = _vec(spark, d, 20).select("query_id", "rank", F.col("vec_id").alias("item"))
    q = labels.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = q.join(labels, "label").where("query_id <> vec_id").select("query_id", F.col("vec_id").alias("item"))
    return results, relevant


def ranking_metrics(spark, d):
    m = E.ranking_metrics(*_ranked(spark, d), 10)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("rr", "ndcg", "recall", "precision")])


def method_compare(spark, d):
    results, relevant = _ranked(spark, d)
    other = results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("item")))
    both = [E.ranking_metrics(r, relevant, 10).withColumn("method", F.lit(n)) for n, r in (("vector", results), ("by_id", other))]
    return E.averages(both[0].unionByName(both[1]), ["method"])


def failed_queries(spark, d):
    return E.ranking_metrics(*_ranked(spark, d), 20).where("recall = 0").select("query_id")


def by_category_difficulty(spark, d):
    """Averages by category, by difficulty and in all, in one pass of grouping sets."""
    m = E.ranking_metrics(*_ranked(spark, d), 10).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("category")), "query_id")
    m = m.withColumn("difficulty", F.when(F.pmod("query_id", F.lit(3)) == 0, "easy").when(F.pmod("query_id", F.lit(3)) == 1, "medium").otherwise("hard"))
    return m.groupingSets([[F.col("category")], [F.col("difficulty")], []], F.col("category"), F.col("difficulty")).agg(F.count("*").alias("n"), F.round(F.avg("rr"), 6).alias("mrr"))


def authority_metrics(spark, d):
    return E.authority_metrics(_results(spark, d).select("query_id", "rank", "doc_type"))


def kinds_by_rank(spark, d):
    return E.kinds_by_rank(_results(spark, d).select("query_id", "rank", "doc_type"))


def _answers(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = table(spark, d, "raw_taas")
    g = t.select("raw_id", F.explode(T.statute_citations(F.col("text"))).alias("c"))
    e = t.select("raw_id", F.explode("metadata.statutes_cited").alias("c")).where("c is not null and trim(c) <> ''").distinct()
    return g, e, t.select("raw_id")


def citation_scores(spark, d):
    return E.citation_scores(*_answers(spark, d), "raw_id")


def answer_contains(spark, d):
    t = table(spark, d, "raw_taas")
    return t.select("raw_id", F.round(T.contains_share(F.col("text"), F.array_compact("metadata.topics")), 6).alias("share"))


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events")


def faithfulness(spark, d):
    v = F.pmod("event_id", F.lit(4))
    verdict = F.when(v == 0, "supported").when(v == 1, "partial").when(v == 2, "contradicted").otherwise("not_supported")
    return E.faithfulness(_events(spark, d).select("user_id", verdict.alias("verdict")), "user_id")


def correction_metrics(spark, d):
    e = _events(spark, d)
    issues, fixed, tries = F.pmod("event_id", F.lit(5)), F.pmod("event_id", F.lit(3)), F.pmod("event_id", F.lit(2))
    action = E.correction_action(F.pmod("event_id", F.lit(4)) != 0, F.least(issues, fixed), F.when(issues > 3, tries).otherwise(0))
    return E.correction_metrics(e.select(action.alias("action"), issues.alias("issues"), F.least(issues, fixed).alias("corrected"), (F.pmod("event_id", F.lit(11)) / 10 - 0.5).alias("delta")))


def severity_bins(spark, d):
    s = F.pmod("event_id", F.lit(100)) / 100
    return _events(spark, d).select("event_type", E.severity_bin(s).alias("bin"), s.alias("s")).groupBy("event_type", "bin").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("avg_severity"), F.max("s").alias("max_severity"))


def validation_decisions(spark, d):
    s = F.pmod("event_id", F.lit(100)) / 100
    per = _events(spark, d).groupBy("user_id").agg(F.avg(s * F.pmod("user_id", F.lit(7)) / 6).alias("mean"), F.max(s * F.pmod("user_id", F.lit(7)) / 6).alias("worst"), F.lit(0.85).alias("accuracy"))
    return E.validation_decision(per).groupBy("decision").agg(F.count("*").alias("n"))


def ablation(spark, d):
    e = _events(spark, d).groupBy((F.pmod("event_id", F.lit(2)) == 0).alias("validated")).agg(F.count_if(F.pmod("event_id", F.lit(6)) == 1).alias("errors"), F.round(F.avg(F.pmod("event_id", F.lit(10)) / 10), 6).alias("score"))
    return E.ablation(e)


def answer_confidence(spark, d):
    r = _results(spark, d)
    return E.answer_confidence(r, r.where("rank <= 8").select("query_id", (F.pmod("doc_id", F.lit(3)) != 0).alias("verified")), "query_id")


def latency_stats(spark, d):
    return O.latency_summary(_events(spark, d), ["event_type"], "value", F.pmod("event_id", F.lit(9)) == 0)


def pctl_index(spark, d):
    return O.percentile_at(_events(spark, d), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def pctl_interp(spark, d):
    return O.interpolated(_events(spark, d), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def stage_profile(spark, d):
    return O.stage_profile(_events(spark, d), "user_id", "event_type", "value", "event_id")


def window_rate(spark, d):
    return O.window_counts(_events(spark, d).select("event_id", "user_id", "ts"), "user_id", "ts", 21600).select("event_id", "in_window")


def hit_rates(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.round(O.hit_rate(F.count_if(F.col("value") > 50), F.count("*")), 6).alias("hit_rate"))


def limiter(spark, d):
    return O.limited(_events(spark, d).select("event_id", "user_id", "ts"), "user_id", "ts", 3, 21600, ["ts", "event_id"]).select("event_id", "passed")


def cache_hits(spark, d):
    return O.cached(_events(spark, d).select("event_id", "user_id", "ts"), "user_id", "ts", 21600, ["ts", "event_id"]).select("event_id", "hit")


def benchmark_compare(spark, d):
    e = _events(spark, d)
    half = lambda k: e.where(F.pmod("event_id", F.lit(2)) == k).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("avg"))
    return O.compare(half(0), half(1), "event_type", "avg")


def health(spark, d):
    checks = table(spark, d, "graph_documents").groupBy().agg((F.count("*") > 0).alias("ok")).unionAll(table(spark, d, "graph_documents").groupBy("id").count().agg((F.max("count") <= 1).alias("ok")))
    return O.health(checks)


def event_windows(spark, d):
    """Hourly counts and means by type."""
    w = F.window("ts", "1 hour")
    return _events(spark, d).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg")).select(F.col("w.start").alias("start"), "event_type", "n", "avg")


def event_sessions(spark, d):
    """Sessions of a user with gaps under six hours."""
    s = F.session_window("ts", "6 hours")
    return _events(spark, d).groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


_F = (
    ranking_metrics, method_compare, failed_queries, by_category_difficulty, authority_metrics, kinds_by_rank, citation_scores, answer_contains, faithfulness, correction_metrics, severity_bins,
    validation_decisions, ablation, answer_confidence, latency_stats, pctl_index, pctl_interp, stage_profile, window_rate, hit_rates, limiter, cache_hits, benchmark_compare, health, event_windows, event_sessions,
)
QUERIES = {f.__name__: f for f in _F}

_RM = f"""WITH {_vsql(20)}, r AS (SELECT query_id, vec_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM vec),
 rel AS (SELECT a.vec_id AS query_id, b.vec_id AS item FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"""


def _metrics(k: int, r: str = "r", name: str = "m") -> str:
    return f""", {name}_h AS (SELECT {r}.query_id, rank, rel.item IS NOT NULL AS hit FROM {r} LEFT JOIN rel ON rel.query_id = {r}.query_id AND rel.item = {r}.item),
 {name} AS (SELECT n.query_id, coalesce(1.0 / min(rank) FILTER (hit), 0)::DOUBLE AS rr, coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= {k}), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n.c, {k}) + 1) t(i)) AS ndcg,
 (count(*) FILTER (hit AND rank <= {k}) / n.c)::DOUBLE AS recall, coalesce(count(*) FILTER (hit AND rank <= {k}) / nullif(count(*) FILTER (rank <= {k}), 0), 0)::DOUBLE AS precision
 FROM (SELECT query_id, count(*) AS c FROM rel GROUP BY 1) n LEFT JOIN {name}_h h ON h.query_id = n.query_id GROUP BY n.query_id, n.c)"""


_BR = f"WITH {_bm25(20)}, r AS (SELECT query_id, doc_id, rank, coalesce(doc_type, 'other') AS doc_type FROM kw JOIN documents USING (doc_id))"
_AW = "CASE lower(doc_type) WHEN 'statute' THEN 3.0 WHEN 'rule' THEN 2.0 WHEN 'case' THEN 2.0 WHEN 'taa' THEN 1.0 ELSE 0.5 END"
_AH = "CASE lower(doc_type) WHEN 'statute' THEN 0 WHEN 'rule' THEN 1 WHEN 'case' THEN 2 WHEN 'taa' THEN 3 ELSE 4 END"
_AVG = "count(*) AS n, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision"

SQL = {
    "ranking_metrics": f"{_RM}{_metrics(10)} SELECT query_id, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(precision, 6) AS precision FROM m",
    "method_compare": f"{_RM}, r2 AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY item) AS rank FROM r){_metrics(10)}{_metrics(10, 'r2', 'm2')} SELECT 'vector' AS method, {_AVG} FROM m UNION ALL SELECT 'by_id', {_AVG} FROM m2",
    "failed_queries": f"{_RM}{_metrics(20)} SELECT query_id FROM m WHERE recall = 0",
    "by_category_difficulty": f"{_RM}{_metrics(10)}, x AS (SELECT m.*, label AS category, CASE query_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty FROM m JOIN embeddings ON vec_id = query_id) SELECT category, difficulty, count(*) AS n, round(avg(rr), 6) AS mrr FROM x GROUP BY GROUPING SETS ((category), (difficulty), ())",
    "authority_metrics": f"{_BR}, w AS (SELECT *, {_AW} AS w, {_AH} AS h, row_number() OVER (PARTITION BY query_id ORDER BY {_AW} DESC, rank) AS ideal FROM r), a AS (SELECT query_id, sum(w / log2(rank + 1)) FILTER (rank <= 10) / sum(w / log2(ideal + 1)) FILTER (ideal <= 10) AS nd, avg(CASE WHEN lower(doc_type) IN ('statute','rule') THEN 1.0 ELSE 0.0 END) FILTER (rank <= 10) AS pr FROM w GROUP BY 1), p AS (SELECT a.query_id, avg(CASE WHEN a.h <= b.h THEN 1.0 ELSE 0.0 END) AS al FROM w a JOIN w b ON a.query_id = b.query_id AND a.rank < b.rank AND b.rank <= 10 GROUP BY 1) SELECT a.query_id, round(nd, 6)::DOUBLE AS authority_ndcg, round(coalesce(al, 1), 6)::DOUBLE AS alignment, round(pr, 6)::DOUBLE AS primary_rate FROM a LEFT JOIN p ON p.query_id = a.query_id",
    "kinds_by_rank": f"{_BR} SELECT rank::INT AS rank, count(*) FILTER (doc_type = 'statute') AS statute, count(*) FILTER (doc_type = 'rule') AS rule, count(*) FILTER (doc_type = 'case') AS \"case\", count(*) FILTER (doc_type = 'taa') AS taa FROM r WHERE rank <= 5 GROUP BY rank",
    "answer_contains": "SELECT raw_id, round(CASE WHEN coalesce(len(t), 0) = 0 THEN 1.0 ELSE len(list_filter(t, lambda x: contains(lower(text), lower(x)))) / len(t) END, 6)::DOUBLE AS share FROM (SELECT raw_id, text, list_filter(metadata.topics, lambda x: x IS NOT NULL) AS t FROM raw_taas)",
    "faithfulness": "WITH c AS (SELECT user_id, event_id % 4 AS v FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (v = 0) AS supported, count(*) FILTER (v = 1) AS partial, count(*) FILTER (v = 2) AS contradicted, count(*) FILTER (v = 3) AS not_supported, round(least(1.0, greatest(0.0, sum(CASE v WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN -0.5 ELSE 0.0 END)::DOUBLE / count(*))), 6) AS score FROM c GROUP BY user_id",
    "correction_metrics": "WITH e AS (SELECT event_id % 5 AS issues, least(event_id % 5, event_id % 3) AS fixed, CASE WHEN event_id % 5 > 3 THEN event_id % 2 ELSE 0 END AS tries, event_id % 4 <> 0 AS passed, (event_id % 11) / 10 - 0.5 AS delta FROM events), a AS (SELECT *, CASE WHEN fixed > 0 THEN 'corrected' WHEN tries > 0 THEN 'regenerated' WHEN passed THEN 'none' ELSE 'failed' END AS action FROM e), g AS (SELECT count(*) AS n_queries, count(*) FILTER (issues > 0) AS n_with_issues, count(*) FILTER (action = 'corrected') AS n_corrected, count(*) FILTER (action = 'regenerated') AS n_regenerated, count(*) FILTER (action = 'failed') AS n_failed, sum(issues)::BIGINT AS n_issues, sum(fixed)::BIGINT AS n_corrections, count(*) FILTER (action <> 'none') AS n_acted, round(avg(delta) FILTER (action <> 'none'), 6) AS avg_delta FROM a) SELECT *, round(n_acted / greatest(n_queries, 1), 6) AS intervention_rate, round(n_regenerated / greatest(n_queries, 1), 6) AS regeneration_rate, CASE WHEN n_issues = 0 THEN 1.0 ELSE round(n_corrections / greatest(n_issues, 1), 6) END AS success_rate FROM g",
    "severity_bins": "WITH e AS (SELECT event_type, (event_id % 100) / 100 AS s FROM events) SELECT event_type, CASE WHEN s < 0.3 THEN 'low' WHEN s < 0.5 THEN 'medium' WHEN s < 0.7 THEN 'high' ELSE 'critical' END AS bin, count(*) AS n, round(avg(s), 6) AS avg_severity, max(s) AS max_severity FROM e GROUP BY 1, 2",
    "validation_decisions": "WITH p AS (SELECT user_id, avg((event_id % 100) / 100 * (user_id % 7) / 6) AS mean, max((event_id % 100) / 100 * (user_id % 7) / 6) AS worst FROM events GROUP BY 1) SELECT CASE WHEN worst >= 0.9 OR mean >= 0.7 THEN 'regenerate' WHEN mean >= 0.3 THEN 'correct' ELSE 'accept' END AS decision, count(*) AS n FROM p GROUP BY 1",
    "ablation": "WITH s AS (SELECT event_id % 2 = 0 AS validated, count(*) FILTER (event_id % 6 = 1) AS errors, round(avg((event_id % 10) / 10), 6) AS score FROM events GROUP BY 1), p AS (SELECT max(errors) FILTER (validated) AS errors_with, max(score) FILTER (validated) AS score_with, max(errors) FILTER (NOT validated) AS errors_without, max(score) FILTER (NOT validated) AS score_without FROM s) SELECT *, errors_without - errors_with AS errors_delta, round(score_with - score_without, 6) AS score_delta, greatest(0, errors_without - errors_with) AS errors_prevented FROM p",
    "answer_confidence": f"{_BR} SELECT query_id, round(least(1.0, greatest(0.0, 0.6 * avg(CASE doc_type WHEN 'statute' THEN 1.0 WHEN 'rule' THEN 0.9 WHEN 'case' THEN 0.7 WHEN 'taa' THEN 0.6 ELSE 0.5 END) FILTER (rank <= 5) + 0.4 * coalesce(avg(CASE WHEN doc_id % 3 <> 0 THEN 1.0 ELSE 0.0 END) FILTER (rank <= 8), 0.5))), 6)::DOUBLE AS confidence FROM r GROUP BY query_id",
    "latency_stats": "SELECT event_type, count(*) AS n, round(avg(value), 2) AS avg, round(min(value), 2) AS min, round(max(value), 2) AS max, round(count(*) FILTER (event_id % 9 <> 0) * 100 / count(*), 2) AS success_pct FROM events GROUP BY event_type",
    "pctl_index": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (i = n // 2) AS p50, max(value) FILTER (i = least(floor(n * 0.95), n - 1)) AS p95, max(value) FILTER (i = least(floor(n * 0.99), n - 1)) AS p99 FROM r GROUP BY event_type",
    "pctl_interp": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
    "stage_profile": "SELECT user_id, event_type, round(sum(value), 6) AS total, min(event_id) AS first_seen, count(*) AS n FROM events GROUP BY 1, 2",
    "window_rate": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 21600 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events",
    "hit_rates": "SELECT event_type, round(count(*) FILTER (value > 50) / count(*), 6) AS hit_rate FROM events GROUP BY event_type",
    "benchmark_compare": "WITH a AS (SELECT event_type, round(avg(value), 6) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, round(avg(value), 6) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT coalesce(a.event_type, b.event_type) AS event_type, a.v AS before, b.v AS after, round(b.v - a.v, 6) AS delta, round((b.v - a.v) * 100 / a.v, 4) AS pct FROM a FULL JOIN b ON a.event_type = b.event_type",
    "health": "WITH c AS (SELECT count(*) > 0 AS ok FROM graph_documents UNION ALL SELECT max(n) <= 1 FROM (SELECT count(*) AS n FROM graph_documents GROUP BY id)) SELECT CASE WHEN bool_and(ok) THEN 'healthy' WHEN bool_or(ok) THEN 'degraded' ELSE 'unhealthy' END AS status FROM c",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS avg FROM events GROUP BY 1, 2",
    "event_sessions": "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS \"end\", count(*) AS n FROM s GROUP BY user_id, k",
}
_NC = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(c)), '^(fla\.?\s*stat\.?\s*)?§?\s*', ''), '^(rule\s+|f\.?a\.?c\.?\s*r?\.?\s*)', ''), '\s+', '', 'g')"
from statloom.queries.ingest import _ST  # noqa: E402

SQL["citation_scores"] = (
    f"WITH g0 AS (SELECT raw_id, unnest(list_distinct(list_transform(list_zip(regexp_extract_all(text, '{_ST}', 1), regexp_extract_all(text, '{_ST}', 2), regexp_extract_all(text, '{_ST}', 3), regexp_extract_all(text, '{_ST}', 4)), "
    "lambda m: (CASE WHEN m[1] <> '' THEN m[1] ELSE m[3] END) || lower(CASE WHEN m[1] <> '' THEN m[2] ELSE m[4] END)))) AS c FROM raw_taas), "
    "e0 AS (SELECT DISTINCT raw_id, c FROM (SELECT raw_id, unnest(metadata.statutes_cited) AS c FROM raw_taas) WHERE c IS NOT NULL AND trim(c) <> ''), "
    rf"g AS (SELECT *, {_NC} AS n, regexp_replace({_NC}, '\([^)]*\)', '', 'g') AS b FROM g0), e AS (SELECT *, {_NC} AS n, regexp_replace({_NC}, '\([^)]*\)', '', 'g') AS b FROM e0), "
    "m AS (SELECT g.raw_id, count(DISTINCT g.c) AS og, count(DISTINCT e.c) AS oe FROM g JOIN e ON g.raw_id = e.raw_id AND (g.b = e.b OR (starts_with(g.n, e.n) AND substr(g.n, length(e.n) + 1, 1) = '(')) GROUP BY 1), "
    "j AS (SELECT t.raw_id, coalesce(ng, 0) AS ng, coalesce(ne, 0) AS ne, coalesce(og, 0) AS og, coalesce(oe, 0) AS oe FROM raw_taas t LEFT JOIN (SELECT raw_id, count(*) AS ng FROM g GROUP BY 1) x USING (raw_id) LEFT JOIN (SELECT raw_id, count(*) AS ne FROM e GROUP BY 1) y USING (raw_id) LEFT JOIN m USING (raw_id)), "
    "p AS (SELECT raw_id, CASE WHEN ng = 0 OR ne = 0 THEN 1.0 ELSE og / ng END::DOUBLE AS p, CASE WHEN ne = 0 THEN 1.0 ELSE oe / ne END::DOUBLE AS r FROM j) "
    "SELECT raw_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM p"
)
SQL["cache_hits"] = (
    "WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), "
    "f AS (SELECT event_id, user_id, i, ts AS inserted, false AS hit FROM o WHERE i = 1 UNION ALL SELECT o.event_id, o.user_id, o.i, CASE WHEN o.ts - f.inserted < INTERVAL 21600 SECONDS THEN f.inserted ELSE o.ts END, o.ts - f.inserted < INTERVAL 21600 SECONDS FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1) "
    "SELECT event_id, hit FROM f"
)
SQL["limiter"] = (
    "WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), "
    "f AS (SELECT event_id, user_id, i, [ts] AS kept, true AS passed FROM o WHERE i = 1 UNION ALL "
    "SELECT event_id, user_id, i, CASE WHEN len(k) < 3 THEN list_append(k, ts) ELSE k END, len(k) < 3 FROM "
    "(SELECT o.event_id, o.user_id, o.i, o.ts, list_filter(f.kept, lambda x: x > o.ts - INTERVAL 21600 SECONDS) AS k FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)) "
    "SELECT event_id, passed FROM f"
)
