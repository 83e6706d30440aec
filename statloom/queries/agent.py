"""Queries of agent steps and run reports with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators import agent as G
from statloom.operators import retrieval as R
from statloom.queries.evaluation import _RM, _metrics, by_category_difficulty
from statloom.queries.retrieval import _Q, _bm25, _kw, _vec, _vsql
from statloom.queries.retrieval import SQL as _RETRIEVAL
from statloom.session import table


def decomposed(spark, d) -> DataFrame:
    stub = lambda q: F.concat(F.lit('{"sub_queries": [{"text": "'), q, F.lit(' first", "type": "Rates", "priority": 9}, {"text": "'), q, F.lit(' then", "type": "odd"}]}'))
    return G.decompose(R.questions(spark), stub)


def doubtful_citations(spark, d) -> DataFrame:
    c = table(spark, d, "raw_taas").select(F.explode("metadata.statutes_cited").alias("c")).where("c is not null")
    return c.select("c", G.doubtful_citations(F.col("c")).alias("doubtful")).groupBy("doubtful").agg(F.count("*").alias("n"), F.countDistinct("c").alias("n_distinct"))


def baseline_summary(spark, d) -> DataFrame:
    """Doubtful citations per advisement: their number, and the share of advisements with any."""
    t = table(spark, d, "raw_taas").select("raw_id", F.size(F.filter("metadata.statutes_cited", lambda c: F.coalesce(G.doubtful_citations(c), F.lit(False)))).alias("k"))
    return t.agg(F.count("*").alias("n"), F.sum(F.greatest("k", F.lit(0))).alias("n_doubtful"), F.round(F.avg((F.col("k") > 0).cast("double")), 6).alias("rate"))


def worst_questions(spark, d) -> DataFrame:
    q = table(spark, d, "events").select(F.col("event_id").alias("question_id"), (F.pmod("event_id", F.lit(3)) == 0).alias("passed"), F.when(F.pmod("event_id", F.lit(50)) != 7, F.pmod("event_id", F.lit(11)).cast("double")).alias("score"))
    return G.worst(q)


def debug_dump(spark, d) -> DataFrame:
    kw = _kw(spark, d, 5).select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("doc_id").alias("item"), "score")
    vec = _vec(spark, d, 5).select("query_id", "rank", F.col("vec_id").alias("item"), "score")
    return G.side_by_side({"keyword": kw, "vector": vec}, "item", 5)


def cluster_last(spark, d) -> DataFrame:
    docs = table(spark, d, "legal_documents").where("doc_type = 'case'").select("id", "title", "scraped_at").distinct()
    return G.last_by_cluster(docs, "id", "scraped_at").select("id", "scraped_at")


def load_verification(spark, d) -> DataFrame:
    a = table(spark, d, "legal_chunks").groupBy("level").agg(F.countDistinct("id").alias("n"))
    b = table(spark, d, "graph_chunks").groupBy("level").agg(F.countDistinct("id").alias("n"))
    return G.load_verification(a, b, "level")


def latency_histogram(spark, d) -> DataFrame:
    return G.histogram(table(spark, d, "events"), "value", 0, 200, 10)


def recommendations(spark, d) -> DataFrame:
    cats = by_category_difficulty(spark, d).where("category is not null").select("category", F.col("mrr").alias("recall"))
    totals = table(spark, d, "events").agg((F.avg("value") * 200).alias("latency"), F.avg((F.pmod("event_id", F.lit(2)) == 0).cast("double")).alias("intervention_rate"), F.lit(0.9).alias("faithfulness"))
    return G.recommendations(cats, totals)


def embed_cached(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    cache = docs.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("hash"), F.array(F.length("text").cast("float")).alias("embedding"))
    out = G.embedded(docs, cache, lambda texts: [[float(len(t))] for t in texts], "doc_id", 1)
    return out.select("doc_id", F.element_at("embedding", 1).cast("double").alias("v"))


QUERIES = {f.__name__: f for f in (decomposed, doubtful_citations, baseline_summary, worst_questions, debug_dump, cluster_last, load_verification, latency_histogram, recommendations, embed_cached)}

_DOUBT = "NOT (contains(c, '212') OR contains(c, '213') OR contains(c, '215') OR contains(c, '220') OR contains(c, '196')) AND NOT contains(lower(c), '12a') AND NOT contains(lower(c), '12-') AND regexp_matches(c, '[0-9]') AND contains(c, '.')"
SQL = {
    "decomposed": f"WITH g AS ({_RETRIEVAL['query_gate']}), {_Q}, x AS (SELECT query_id, query, split FROM q JOIN g USING (query_id)) SELECT query_id, 0 AS sub_idx, query || CASE WHEN split THEN ' first' ELSE '' END AS text, CASE WHEN split THEN 'rate' ELSE 'general' END AS type, CASE WHEN split THEN 5 ELSE 1 END AS priority FROM x UNION ALL SELECT query_id, 1, query || ' then', 'general', 1 FROM x WHERE split",
    "doubtful_citations": f"SELECT {_DOUBT} AS doubtful, count(*) AS n, count(DISTINCT c) AS n_distinct FROM (SELECT unnest(metadata.statutes_cited) AS c FROM raw_taas) WHERE c IS NOT NULL GROUP BY 1",
    "baseline_summary": f"WITH k AS (SELECT raw_id, len(list_filter(coalesce(metadata.statutes_cited, []), lambda c: coalesce({_DOUBT}, false))) AS k FROM raw_taas) SELECT count(*) AS n, sum(k)::BIGINT AS n_doubtful, round(avg(CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS rate FROM k",
    "worst_questions": "SELECT event_id AS question_id, event_id % 3 = 0 AS passed, CASE WHEN event_id % 50 <> 7 THEN (event_id % 11)::DOUBLE END AS score FROM events WHERE event_id % 3 <> 0 OR (event_id % 50 <> 7 AND event_id % 11 < 7) ORDER BY score ASC NULLS FIRST, event_id LIMIT 5",
    "debug_dump": f"WITH {_bm25(5)}, {_vsql(5)} SELECT 'keyword' AS method, query_id::BIGINT AS query_id, rank::INT AS rank, doc_id AS item, round(score, 4) AS score FROM kw UNION ALL SELECT 'vector', query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT, vec_id, round(score, 4) FROM vec",
    "cluster_last": "SELECT id, max(scraped_at) AS scraped_at FROM legal_documents WHERE doc_type = 'case' GROUP BY id",
    "load_verification": "WITH a AS (SELECT level, count(DISTINCT id) AS e FROM legal_chunks GROUP BY 1), b AS (SELECT level, count(DISTINCT id) AS a FROM graph_chunks GROUP BY 1) SELECT coalesce(a.level, b.level) AS level, coalesce(e, 0) AS expected, coalesce(b.a, 0) AS actual, coalesce(e, 0) = coalesce(b.a, 0) AS ok FROM a FULL JOIN b ON a.level = b.level",
    "latency_histogram": "SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 200 THEN 11 ELSE floor(value / 20) + 1 END::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1",
    "recommendations": f"{_RM}{_metrics(10)}, x AS (SELECT label AS category, round(avg(rr), 6) AS recall FROM m JOIN embeddings ON vec_id = query_id GROUP BY 1), t AS (SELECT avg(value) * 200 AS latency, avg(CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS i FROM events) SELECT 'expand_corpus' AS kind, category::VARCHAR AS subject, recall AS value FROM x WHERE recall < 0.70 UNION ALL SELECT 'cache_queries', NULL, round(latency, 6) FROM t WHERE latency > 5000 UNION ALL SELECT 'improve_retrieval', NULL, round(i, 6) FROM t WHERE i > 0.3 UNION ALL SELECT 'human_review', NULL, NULL",
    "embed_cached": "SELECT doc_id, length(text)::DOUBLE AS v FROM documents",
}
