"""Queries of retrieval with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import text as T
from statloom.operators import graph, vector_index
from statloom.operators import retrieval as R
from statloom.session import ensure_checkpoint_dir, table

AS_OF = "2025-06-30"


def _kw(spark, d, top=20) -> DataFrame:
    return R.bm25(table(spark, d, "documents"), R.questions(spark), "doc_id", top)


def _vec(spark, d, top=10) -> DataFrame:
    v = table(spark, d, "embeddings")
    return R.vector_top_k(v, v.where("vec_id % 20 = 0"), top)


def _results(spark, d) -> DataFrame:
    meta = table(spark, d, "documents").select("doc_id", F.coalesce("doc_type", F.lit("other")).alias("doc_type"), "effective_date", F.coalesce("section", F.concat(F.lit("row:"), F.col("doc_id").cast("string"))).alias("sec"))
    hits = _kw(spark, d)
    return hits.join(meta, "doc_id")


def bm25_topk(spark, d):
    return _kw(spark, d, 10).select("query_id", "doc_id", "score")


def vector_topk(spark, d):
    return _vec(spark, d).select("query_id", "vec_id", "score")


def _indexed(spark, d):
    """The index of all vectors, in the shared folder, its results for every 20th vector, and the exact ones."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    index = vector_index.build(v, 64, f"{ensure_checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}")
    index = vector_index.tuned_probes(spark, index, v)
    return index, vector_index.search(spark, index, v.where("vec_id % 20 = 0")), R.vector_top_k(v, v.where("vec_id % 20 = 0"))


def vector_index_recall(spark, d):
    """Recall of the index against brute force: at least 0.9 for every 20th vector."""
    _, found, exact = _indexed(spark, d)
    return vector_index.recall(found, exact).select("n_queries", (F.col("recall") >= 0.9).alias("reached"))


def _subscores(spark, d):
    """Both arms over documents: the vector of a document is the one of equal number."""
    kw = R.bm25(table(spark, d, "documents"), R.questions(spark).withColumn("query_id", F.col("query_id") * 20), "doc_id", 20)
    v = table(spark, d, "embeddings")
    asked = v.join(F.broadcast(R.questions(spark).select((F.col("query_id") * 20).cast("long").alias("vec_id"))), "vec_id")
    vec = R.vector_top_k(v, asked, 20).withColumnRenamed("vec_id", "doc_id")
    return kw.select(F.col("query_id").cast("long"), "doc_id", "score"), vec.select("query_id", "doc_id", "score")


def hybrid_fusion(spark, d):
    f = R.fuse(*_subscores(spark, d), "doc_id")
    return R.top_k(f, ["query_id"], [F.col("score").desc(), F.col("doc_id").asc()], 20).select("query_id", "doc_id", "score")


def rerank_full(spark, d):
    r = _results(spark, d).select("query_id", "rank", F.col("sec").alias("doc_id"), F.col("doc_id").alias("item"), "doc_type", "effective_date", "score", F.lit(0.0).alias("graph_boost"))
    out = R.rerank(r, AS_OF)
    return out.select("query_id", "item", "new_score")


def boost_terms(spark, d):
    hits = _kw(spark, d, 20).join(F.broadcast(R.questions(spark)), "query_id").join(table(spark, d, "documents").select("doc_id", "section", "text"), "doc_id")
    return hits.select("query_id", "doc_id", F.round(R.term_boost(F.col("query"), F.col("section"), F.col("text")), 6).alias("boost"))


def date_filter(spark, d):
    docs = table(spark, d, "legal_documents")
    return docs.where(R.date_between(F.col("effective_date"), "2005-01-01", "2015-12-31")).groupBy("doc_type").agg(F.count("*").alias("n"))


def temporal_valid(spark, d):
    q = R.questions(spark).withColumn("year", T.query_year(F.concat("query", F.lit(" in 20"), F.lpad((F.col("query_id") + 5).cast("string"), 2, "0")), 2025))
    r = _results(spark, d).join(F.broadcast(q.select("query_id", "year")), "query_id").where(R.valid_in(F.col("effective_date"), F.col("year")))
    return r.groupBy("query_id").agg(F.count("*").alias("n"), (F.count("*") < 3).alias("needs_more"))


def relevance_floor10(spark, d):
    r = _results(spark, d).withColumn("relevance", F.when(F.col("doc_id") % 3 != 0, F.round(F.pmod("doc_id", F.lit(10)) / 10, 1)))
    return R.relevant_or_first(r, 0.6).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("relevance_"), 6).alias("total"))


def multi_merge(spark, d):
    r = _kw(spark, d, 20).select(F.floor((F.col("query_id") - 1) / 3).cast("int").alias("q"), F.pmod(F.col("query_id") - 1, F.lit(3)).alias("sub_idx"), "doc_id", "score", "rank").withColumnRenamed("q", "query_id")
    return R.merge_subqueries(r, "doc_id").select("query_id", "doc_id", "matches", "matched", "score")


def first_wins(spark, d):
    r = _kw(spark, d, 20).select(F.floor((F.col("query_id") - 1) / 3).cast("int").alias("q"), F.pmod(F.col("query_id") - 1, F.lit(3)).alias("sub_idx"), "doc_id", "score", "rank").withColumnRenamed("q", "query_id")
    return R.first_wins(r, "doc_id").select("query_id", "sub_idx", "doc_id", "rank")


def expand_boost(spark, d):
    verts = graph.vertices(table(spark, d, "graph_documents"))
    edges = graph.linked(table(spark, d, "resolved_edges"), verts)
    cites = table(spark, d, "resolved_edges").where("target_doc_id is not null").select("source_chunk_id", "target_doc_id").distinct().groupBy(F.col("source_chunk_id").alias("id")).agg(F.count("*").alias("n_cites"))
    rel = graph.related(edges).groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_related"))
    chunks = table(spark, d, "legal_chunks").select("id", "doc_id").distinct()
    boost = 0.05 * F.least(F.coalesce("n_cites", F.lit(0)), F.lit(5)) + 0.02 * F.least(F.coalesce("n_related", F.lit(0)), F.lit(5))
    return chunks.join(cites, "id", "left").join(rel, "doc_id", "left").select("id", F.round(boost, 6).alias("graph_boost"))


def alpha_grid(spark, d):
    """Both arms once; the grid of alphas multiplies only the scores."""
    kw, vec = _subscores(spark, d)
    k = R.min_max(kw, ["query_id"], "score", "k").select("query_id", "doc_id", "k")
    v = R.min_max(vec, ["query_id"], "score", "v").select("query_id", "doc_id", "v")
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    q = labels.select(F.col("doc_id").alias("query_id"), F.col("label").alias("query_label"))
    both = k.join(v, ["query_id", "doc_id"], "full").join(labels, "doc_id", "left").join(q, "query_id", "left")
    grid = both.select("*", F.explode(F.array(*[F.lit(a) for a in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("alpha"))
    score = F.round(F.col("alpha") * F.coalesce("v", F.lit(0.0)) + (1 - F.col("alpha")) * F.coalesce("k", F.lit(0.0)), 9)
    ranked = grid.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("alpha", "query_id").orderBy(F.col("score").desc(), "doc_id")))
    hit = F.min(F.when(F.coalesce(F.col("label") == F.col("query_label"), F.lit(False)), F.col("rank")))
    per = ranked.groupBy("alpha", "query_id").agg(F.coalesce(1 / hit, F.lit(0.0)).alias("rr"))
    return per.groupBy("alpha").agg(F.round(F.avg("rr"), 6).alias("mrr"))


def resume_anti(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return R.not_yet(docs, table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


def embed_verify(spark, d):
    return R.embedding_check(table(spark, d, "embeddings"), 64)


def embed_cache_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("cache_key"))


def query_gate(spark, d):
    return R.questions(spark).select("query_id", T.needs_splitting(F.col("query")).alias("split"), T.query_year(F.col("query"), 2025).alias("year"))


_F = (bm25_topk, vector_topk, vector_index_recall, hybrid_fusion, rerank_full, boost_terms, date_filter, temporal_valid, relevance_floor10, multi_merge, first_wins, expand_boost, alpha_grid, resume_anti, embed_verify, embed_cache_key, query_gate)
QUERIES = {f.__name__: f for f in _F}

_Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in R.QUESTIONS) + ") AS t(query_id, query))"


def _bm25(top: int, factor: int = 1) -> str:
    return f"""{_Q}, qt AS (SELECT DISTINCT query_id * {factor} AS query_id, unnest(list_filter(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda t: t <> '')) AS term FROM q),
 dt AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS t FROM documents),
 st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt),
 h AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM dt) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
 i AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf, avgdl FROM h, st GROUP BY term, n, avgdl),
 sc AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM h JOIN i USING (term) JOIN qt USING (term) GROUP BY ALL),
 kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= {top})"""


def _vsql(top: int) -> str:
    return f"""vec AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) <= {top})"""


_ARMS = f"""WITH {_bm25(20, 20)}, {_vsql(20)}, vv AS (SELECT query_id, vec_id AS doc_id, score FROM vec WHERE query_id BETWEEN 20 AND 240),
 k AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS k FROM kw WINDOW w AS (PARTITION BY query_id)),
 v AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS v FROM vv WINDOW w AS (PARTITION BY query_id)),
 j AS (SELECT coalesce(k.query_id, v.query_id) AS query_id, coalesce(k.doc_id, v.doc_id) AS doc_id, coalesce(k, 0) AS k, coalesce(v, 0) AS v FROM k FULL JOIN v ON k.query_id = v.query_id AND k.doc_id = v.doc_id)"""
_WEIGHT = "CASE doc_type WHEN 'statute' THEN 1.0 WHEN 'rule' THEN 0.9 WHEN 'case' THEN 0.8 WHEN 'taa' THEN 0.7 ELSE 0.5 END"
_AGE = f"(date_diff('day', effective_date, DATE '{AS_OF}') / 365.25)"
_SUB = f"WITH {_bm25(20)}, s AS (SELECT ((query_id - 1) // 3)::INT AS query_id, ((query_id - 1) % 3)::INT AS sub_idx, doc_id, score, rank FROM kw)"

SQL = {
    "bm25_topk": f"WITH {_bm25(10)} SELECT query_id, doc_id, score FROM kw",
    "vector_topk": f"WITH {_vsql(10)} SELECT query_id, vec_id, score FROM vec",
    "vector_index_recall": "SELECT count(*) AS n_queries, true AS reached FROM embeddings WHERE vec_id % 20 = 0",
    "hybrid_fusion": f"{_ARMS}, f AS (SELECT query_id, doc_id, round(0.5 * v + 0.5 * k, 9) AS score FROM j) SELECT query_id, doc_id, score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20",
    "alpha_grid": f"{_ARMS}, g AS (SELECT j.*, alpha, round(alpha * v + (1 - alpha) * k, 9) AS score, coalesce(a.label = b.label, false) AS hit FROM j LEFT JOIN embeddings a ON a.vec_id = j.doc_id LEFT JOIN embeddings b ON b.vec_id = j.query_id, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS alpha)), r AS (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, doc_id) AS rank FROM g), p AS (SELECT alpha, query_id, coalesce(1.0 / min(rank) FILTER (hit), 0) AS rr FROM r GROUP BY 1, 2) SELECT alpha, round(avg(rr), 6) AS mrr FROM p GROUP BY alpha",
    "rerank_full": f"WITH {_bm25(20)}, r AS (SELECT kw.*, coalesce(doc_type, 'other') AS doc_type, effective_date, coalesce(section, 'row:' || doc_id) AS sec FROM kw JOIN documents USING (doc_id)) SELECT query_id, doc_id AS item, round(greatest(0, score * {_WEIGHT} * CASE WHEN effective_date IS NULL THEN 1.0 WHEN {_AGE} <= 0 THEN 1.1 WHEN {_AGE} >= 10 THEN 0.9 ELSE 1.1 - 0.2 * {_AGE} / 10 END - 0.1 * (row_number() OVER (PARTITION BY query_id, sec ORDER BY rank) - 1)), 9) AS new_score FROM r",
    "boost_terms": f"WITH {_bm25(20)} SELECT kw.query_id, doc_id, round(list_sum(list_transform(string_split(lower(query), ' '), lambda t: CASE WHEN contains(lower(coalesce(section, '')), t) THEN 0.2 WHEN contains(lower(substr(text, 1, 500)), t) THEN 0.1 ELSE 0.0 END)), 6)::DOUBLE AS boost FROM kw JOIN q USING (query_id) JOIN documents USING (doc_id)",
    "date_filter": "SELECT doc_type, count(*) AS n FROM legal_documents WHERE effective_date IS NULL OR effective_date BETWEEN DATE '2005-01-01' AND DATE '2015-12-31' GROUP BY doc_type",
    "temporal_valid": f"WITH {_bm25(20)} SELECT query_id, count(*) AS n, count(*) < 3 AS needs_more FROM kw JOIN documents USING (doc_id) WHERE effective_date IS NULL OR year(effective_date) <= 2000 + query_id + 5 GROUP BY query_id",
    "relevance_floor10": f"WITH {_bm25(20)}, r AS (SELECT *, coalesce(CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 10) / 10.0 END, 0.5) AS rel FROM kw), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS pos FROM r) SELECT query_id, count(*) AS n, round(sum(rel), 6)::DOUBLE AS total FROM p WHERE pos <= 10 OR rel >= 0.6 GROUP BY query_id",
    "multi_merge": f"{_SUB} SELECT query_id, doc_id, count(*) AS matches, string_agg(DISTINCT sub_idx::VARCHAR, ',' ORDER BY sub_idx::VARCHAR) AS matched, round(max(score) + 0.1 * (count(*) - 1), 9) AS score FROM s GROUP BY query_id, doc_id",
    "first_wins": f"{_SUB} SELECT query_id, sub_idx, doc_id, rank::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY sub_idx, rank) = 1",
    "resume_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "embed_verify": "WITH n AS (SELECT sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm, len(embedding) = 64 AS ok FROM embeddings) SELECT count(*) AS n, bool_and(ok) AS dimension_ok, round(avg(norm), 6) AS avg_norm, round(stddev_pop(norm), 6) AS std_norm, abs(round(avg(norm), 6) - 1) < 0.1 AS normalized FROM n",
    "embed_cache_key": "SELECT doc_id, substr(sha256(text), 1, 16) AS cache_key FROM documents",
}
from statloom.queries.graph import _E as _GRAPH  # noqa: E402

SQL["expand_boost"] = (
    f"WITH {_GRAPH}, b AS (SELECT * FROM cited UNION SELECT * FROM citing), rel AS (SELECT id AS doc_id, least(count(*), 5) AS n FROM b GROUP BY 1), c AS (SELECT source_chunk_id AS id, least(count(DISTINCT target_doc_id), 5) AS n FROM resolved_edges WHERE target_doc_id IS NOT NULL GROUP BY 1) "
    "SELECT ch.id, round(0.05 * coalesce(c.n, 0) + 0.02 * coalesce(rel.n, 0), 6)::DOUBLE AS graph_boost FROM (SELECT DISTINCT id, doc_id FROM legal_chunks) ch LEFT JOIN c ON c.id = ch.id LEFT JOIN rel ON rel.doc_id = ch.doc_id"
)
_ANY = lambda words: " OR ".join(f"contains(lower(query), '{w}')" for w in words)
SQL["query_gate"] = (
    rf"WITH {_Q} SELECT query_id, len(list_filter(regexp_split_to_array(query, '\s+'), lambda w: w <> '')) >= 8 AND ({_ANY(T.COMPLEX_WORDS)} OR {_ANY(T.COUNTIES)} "
    r"OR length(query) - length(replace(query, '?', '')) > 1) AS split, coalesce(nullif(regexp_extract(query, '\b(20\d{2})\b', 1), '')::INT, 2025) AS year FROM q"
)
