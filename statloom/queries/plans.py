"""Queries of whole pipelines and of the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators import evaluation as E
from statloom.operators import retrieval as R
from statloom.plans import pipeline
from statloom.queries.graph import _E as _GRAPH
from statloom.queries.ingest import INGEST_EDGES
from statloom.queries.retrieval import _AGE, _WEIGHT, AS_OF, _bm25
from statloom.session import ensure_checkpoint_dir, table
from statloom.streaming import streams


def retrieve_pipeline(spark, d) -> DataFrame:
    """As in hybrid_fusion a document's vector is the one of equal number, a question's the one of
    twenty times its number."""
    docs = table(spark, d, "documents").withColumn("graph_id", F.concat("doc_type", F.lit(":"), "section"))
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    questions = R.questions(spark)
    asked = vectors.join(F.broadcast(questions.select("query_id", (F.col("query_id") * 20).alias("vec_id"))), "vec_id").select(F.col("query_id").alias("vec_id"), "embedding")
    found = pipeline.retrieve(docs, questions, vectors, asked, table(spark, d, "resolved_edges"), table(spark, d, "graph_documents"), AS_OF, 10, "1995-01-01", "2020-12-31")
    return found.withColumn("score", F.round("score", 6))


def _methods(spark, d) -> DataFrame:
    """Results of the four methods: vectors alone, keywords alone, both, and both with the graph."""
    docs = table(spark, d, "documents").withColumn("graph_id", F.concat("doc_type", F.lit(":"), "section"))
    vectors, questions = table(spark, d, "embeddings").select("vec_id", "embedding"), R.questions(spark)
    asked = vectors.join(F.broadcast(questions.select("query_id", (F.col("query_id") * 20).alias("vec_id"))), "vec_id").select(F.col("query_id").alias("vec_id"), "embedding")
    ensure_checkpoint_dir(spark)
    found = tuple(arm.checkpoint() for arm in pipeline.arms(docs, questions, vectors, asked, 20))  # a few rows a question, used by four methods
    how = {"vector": {"alpha": 1.0, "expand": False, "again": False}, "keyword": {"alpha": 0.0, "expand": False, "again": False}, "hybrid": {"expand": False}, "graph": {}}
    out = None
    for name, options in how.items():
        one = pipeline.ranked(found, docs, table(spark, d, "resolved_edges"), table(spark, d, "graph_documents"), AS_OF, 10, **options).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def method_results(spark, d) -> DataFrame:
    return _methods(spark, d).withColumn("score", F.round("score", 6))


def method_best(spark, d) -> DataFrame:
    """Per question the method of the highest reciprocal rank (the first of vector, keyword, hybrid,
    graph on ties), a result being relevant that carries the label of the question's vector."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    wanted = labels.select((F.col("doc_id") / 20).cast("int").alias("query_id"), F.col("label").alias("wanted"), "doc_id").where("doc_id % 20 = 0").drop("doc_id")
    return E.best_method(_methods(spark, d).join(labels, "doc_id", "left").join(wanted, "query_id"), F.col("label") == F.col("wanted"), ["vector", "keyword", "hybrid", "graph"])


def ingest_edges(spark, d) -> DataFrame:
    _, _, edges = pipeline.ingest(table(spark, d, "raw_statutes"), table(spark, d, "raw_taas"))
    return edges.select("source_doc_id", "target_doc_id", "relation_type", "confidence")


def _stream(spark, d, make) -> DataFrame:
    """Runs a stream over the event files once and reads its table."""
    base = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    events = streams.file_events(spark, d, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    streams.run_to_table(make(events), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out")


def stream_limiter(spark, d) -> DataFrame:
    return _stream(spark, d, lambda e: streams.limited(e, "user_id", "ts", 3, 21600)).select("event_id", "passed")


def stream_cache(spark, d) -> DataFrame:
    return _stream(spark, d, lambda e: streams.cached(e, "user_id", "ts", 21600)).select("event_id", "hit")


def stream_once(spark, d) -> DataFrame:
    return _stream(spark, d, lambda e: streams.once(e, "event_id", "ts")).groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (retrieve_pipeline, method_results, method_best, ingest_edges, stream_limiter, stream_cache, stream_once)}
from statloom.queries.evaluation import SQL as _EVAL  # noqa: E402

_SCALED = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"


def _arms(top: int) -> str:
    """CTEs of both arms, scaled, the graph's boosts, and what is known of each document."""
    return f"""WITH {_bm25(2 * top)}, {_GRAPH},
 qv AS (SELECT query_id, embedding FROM q JOIN embeddings ON vec_id = query_id * 20),
 vec AS (SELECT query_id, e.vec_id AS doc_id, round(list_cosine_similarity(qv.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM qv, embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, e.vec_id) <= {2 * top}),
 ks AS (SELECT query_id, doc_id, {_SCALED} AS k FROM kw WINDOW w AS (PARTITION BY query_id)), vs AS (SELECT query_id, doc_id, {_SCALED} AS v FROM vec WINDOW w AS (PARTITION BY query_id)),
 both_arms AS (SELECT coalesce(ks.query_id, vs.query_id) AS query_id, coalesce(ks.doc_id, vs.doc_id) AS doc_id, coalesce(k, 0) AS k, coalesce(v, 0) AS v FROM ks FULL JOIN vs ON ks.query_id = vs.query_id AND ks.doc_id = vs.doc_id),
 nc AS (SELECT source_doc_id AS id, count(DISTINCT target_doc_id) AS n FROM resolved_edges WHERE target_doc_id IS NOT NULL GROUP BY 1), nr AS (SELECT id, count(*) AS n FROM (SELECT * FROM cited UNION SELECT * FROM citing) GROUP BY 1),
 boosts AS (SELECT coalesce(nc.id, nr.id) AS id, round(0.05 * least(coalesce(nc.n, 0), 5) + 0.02 * least(coalesce(nr.n, 0), 5), 6)::DOUBLE AS boost FROM nc FULL JOIN nr ON nc.id = nr.id),
 known AS (SELECT doc_id, doc_type, effective_date, coalesce(doc_type || ':' || section, 'row:' || doc_id) AS grp, coalesce(boost, 0) AS boost FROM documents LEFT JOIN boosts ON id = doc_type || ':' || section)"""


def _run(name: str, top: int, alpha: float, expand: bool, again: bool, where: str = "true") -> str:
    """CTEs of one run, the last named ``name``."""
    boost = "boost" if expand else "0"
    recent = f"CASE WHEN effective_date IS NULL THEN 1.0 WHEN {_AGE} <= 0 THEN 1.1 WHEN {_AGE} >= 10 THEN 0.9 ELSE 1.1 - 0.2 * {_AGE} / 10 END"
    s = f"greatest(0, score * {_WEIGHT} * {recent} + {boost} - 0.1 * (row_number() OVER (PARTITION BY query_id, grp ORDER BY r0) - 1))" if again else f"score + {boost}"
    return f"""{name}_h AS (SELECT query_id, doc_id, round({alpha} * v + {1 - alpha} * k, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round({alpha} * v + {1 - alpha} * k, 9) DESC, doc_id) AS r0 FROM both_arms QUALIFY r0 <= {2 * top}),
 {name}_s AS (SELECT query_id, doc_id, r0, round({s}, 9)::DOUBLE AS score FROM {name}_h JOIN known USING (doc_id) WHERE {where}),
 {name} AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0)::INT AS rank FROM {name}_s QUALIFY rank <= {top})"""


_ALL = _arms(10) + ", " + ", ".join([_run("vector_m", 10, 1.0, False, False), _run("keyword_m", 10, 0.0, False, False), _run("hybrid_m", 10, 0.5, False, True), _run("graph_m", 10, 0.5, True, True)])
_UNION = " UNION ALL ".join(f"SELECT query_id, doc_id, score, rank, '{m}' AS method FROM {m}_m" for m in ("vector", "keyword", "hybrid", "graph"))
SQL = {
    "retrieve_pipeline": _arms(10) + ", " + _run("run", 10, 0.5, True, True, "effective_date IS NULL OR effective_date BETWEEN DATE '1995-01-01' AND DATE '2020-12-31'") + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM run",
    "method_results": f"{_ALL} SELECT query_id, doc_id, round(score, 6) AS score, rank, method FROM ({_UNION})",
    "method_best": f"{_ALL}, x AS ({_UNION}), y AS (SELECT x.query_id, method, coalesce(1.0 / min(rank) FILTER (a.label = b.label), 0) AS rr, CASE method WHEN 'vector' THEN 0 WHEN 'keyword' THEN 1 WHEN 'hybrid' THEN 2 ELSE 3 END AS o FROM x JOIN embeddings b ON b.vec_id = x.query_id * 20 LEFT JOIN embeddings a ON a.vec_id = x.doc_id GROUP BY ALL) SELECT query_id, method AS best_method, round(rr, 6)::DOUBLE AS best_rr FROM y QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, o) = 1",
    "ingest_edges": INGEST_EDGES,
    "stream_cache": _EVAL["cache_hits"],
    "stream_limiter": _EVAL["limiter"],
    "stream_once": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
}
