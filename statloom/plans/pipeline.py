"""Whole pipelines as one lazy plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators import chunking, citations, corpus, graph
from statloom.operators import retrieval as R


def arms(documents: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """The best ``top`` documents of each question by keywords and by vectors: (query_id, doc_id, score)."""
    keyword = R.bm25(documents, queries, "doc_id", top).select("query_id", "doc_id", "score")
    searched = vectors.join(documents.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    vector = R.vector_top_k(searched, query_vectors, top, others=False).select("query_id", F.col("vec_id").alias("doc_id"), "score")
    return keyword, vector


def ranked(
    found: tuple[DataFrame, DataFrame], documents: DataFrame, edges: DataFrame, graph_documents: DataFrame, as_of: str,
    top: int = 20, lo: str | None = None, hi: str | None = None, alpha: float = 0.5, expand: bool = True, again: bool = True,
) -> DataFrame:
    """Both arms fused and cut, dates filtered, boosted by the citation graph (with ``expand``),
    re-ranked (with ``again``), cut."""
    hits = R.top_k(R.fuse(*found, "doc_id", alpha), ["query_id"], [F.col("score").desc(), F.col("doc_id").asc()], 2 * top)
    own = F.coalesce("graph_id", F.concat(F.lit("row:"), F.col("doc_id").cast("string")))
    meta = documents.select("doc_id", "doc_type", "effective_date", own.alias("group"), "graph_id")
    rows = hits.join(meta, "doc_id").where(R.date_between(F.col("effective_date"), lo, hi))
    if expand:
        boost = graph.document_boost(edges, graph.vertices(graph_documents)).withColumnRenamed("id", "graph_id")
        rows = rows.join(boost, "graph_id", "left")
    else:
        rows = rows.withColumn("graph_boost", F.lit(0.0))
    shaped = rows.select("query_id", "rank", F.col("group").alias("doc_id"), F.col("doc_id").alias("item"), "doc_type", "effective_date", "score", F.coalesce("graph_boost", F.lit(0.0)).alias("graph_boost"))
    if not again:
        plain = shaped.withColumn("new_score", F.round(F.col("score") + F.col("graph_boost"), 9))
        final = R.top_k(plain, ["query_id"], [F.col("new_score").desc(), F.col("rank").asc()], top, "new_rank")
    else:
        final = R.rerank(shaped, as_of).where(F.col("new_rank") <= top)
    return final.select("query_id", F.col("item").alias("doc_id"), F.col("new_score").alias("score"), F.col("new_rank").alias("rank"))


def retrieve(
    documents: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, edges: DataFrame, graph_documents: DataFrame, as_of: str,
    top: int = 20, lo: str | None = None, hi: str | None = None, filters: dict[str, object] | None = None, prefilter: bool = False, **how,
) -> DataFrame:
    """Questions to ranked documents: filters before the search, twice the results fetched from
    keywords and from vectors, then :func:`ranked` (dates are filtered there, after the cut, or
    before the search with ``prefilter``).

    ``vectors`` (vec_id is the document's id) and ``query_vectors`` (vec_id is the query's id) hold
    embeddings; ``graph_id`` of a row names its document in the graph, whose rows penalise one
    another (a row without one stands for itself).
    """
    docs = R.matching(documents, filters)
    if prefilter:
        docs = docs.where(R.date_between(F.col("effective_date"), lo, hi))
    return ranked(arms(docs, queries, vectors, query_vectors, 2 * top), docs, edges, graph_documents, as_of, top, lo, hi, **how)


def retrieve_all(documents: DataFrame, subqueries: DataFrame, top: int = 20, boost: float = 0.1) -> DataFrame:
    """Sub-queries (query_id, sub_idx, text) searched in one batch and merged by question: one row a
    document with its best score, raised for each further sub-query that found it.  A sub-query
    without a text finds nothing and stops no other."""
    numbered = subqueries.where("text is not null").select(F.to_json(F.struct("query_id", "sub_idx")).alias("sub"), "query_id", "sub_idx", F.col("text").alias("query"))
    hits = R.bm25(documents, numbered.select(F.col("sub").alias("query_id"), "query"), "doc_id", top).withColumnRenamed("query_id", "sub")
    found = hits.join(numbered.select("sub", "query_id", "sub_idx"), "sub").drop("sub")
    return R.merge_subqueries(found, "doc_id", boost)


def ingest(raw_statutes: DataFrame, raw_taas: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw records to (documents, chunks, edges); each is a lazy plan to be written once."""
    docs = corpus.latest_by(corpus.consolidate(corpus.statutes_to_documents(raw_statutes), corpus.taas_to_documents(raw_taas)), "id", F.col("scraped_at").desc(), F.col("raw_id").desc())
    chunks = chunking.chunk_documents(corpus.with_paths(docs, F.regexp_extract("parent_id", "chapter_(.*)$", 1), F.col("tax_type")))
    edges = citations.citation_graph(chunks).where("target_doc_id is not null")
    kept = edges.select(F.col("id").alias("source_chunk_id"), F.col("doc_id").alias("source_doc_id"), "target_doc_id", "target_chunk_id", "relation_type", F.col("raw").alias("citation_text"), "confidence")
    return docs, chunks, citations.best_edges(kept, "source_chunk_id")
