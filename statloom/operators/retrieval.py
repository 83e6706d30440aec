"""Retrieval in batches of queries: BM25, vectors, fusion, re-ranking, merging, cut-offs.

Query sets (questions, or a grid of parameters) are broadcast up to a stated bound; above it they
are joined or taken in blocks.  Documents, postings and vectors are never broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.session import ensure_checkpoint_dir

# BM25 constants and the weights of kinds in re-ranking.
K1, B = 1.2, 0.75
KIND_WEIGHT = {"statute": 1.0, "rule": 0.9, "case": 0.8, "taa": 0.7}
OTHER_WEIGHT = 0.5
RECENCY_YEARS, RECENCY_BEST, RECENCY_WORST = 10, 1.1, 0.9
DIVERSITY = 0.1
#: Most queries of one batch that are broadcast, and most query terms that are looked up row by row.
MOST_QUERIES, MOST_TERMS = 10_000, 2_000
#: Queries and vectors that are multiplied at once.
TILE = 1024

#: The standard questions of this library's own checks (id, text).
QUESTIONS = [
    (1, "sales tax on hurricane shutters"), (2, "exemption certificate for printed circulars"), (3, "penalty for failing to file a quarterly return"),
    (4, "refund of tax paid on dyed diesel fuel"), (5, "surtax rate in Norbeck County"), (6, "use tax on aircraft parts outside the state"),
    (7, "is prewritten software taxable"), (8, "documentary stamp tax on a lease"), (9, "membership charge part of the sales price"),
    (10, "interest accrues from the due date"), (11, "resale certificate requirements for dealers"), (12, "appeal of a final order assessing corporate income tax"),
]


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id int, query string")


def terms(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")


def postings(documents: DataFrame, key: str, text: str = "text", only: list[str] | None = None) -> DataFrame:
    """(key, dl, term, tf): one row per distinct term of a text (of ``only`` these terms, if given),
    counted inside its row: nothing is shuffled, and no other token leaves its row."""
    listed = documents.select(F.col(key), terms(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
    if only is not None:
        listed = listed.withColumn("t", F.filter("t", lambda x: x.isin(*only)) if only else F.array().cast("array<string>"))
    counted = F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("term"), (F.size("t") - F.size(F.array_remove("t", x))).alias("tf")))
    return listed.select(key, "dl", F.inline(counted))


def bm25(documents: DataFrame, queries: DataFrame, key: str, top: int = 10, text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """Best ``top`` documents of each query by BM25, ties by key.

    Up to ``MOST_TERMS`` query terms are looked up inside each document's row, so that only matches
    leave it; beyond that the tokens are joined with the terms.  Either way the matches (numbers and
    terms, no texts) are written once to the checkpoint folder and read for both the document
    frequencies and the scores.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    few_queries = queries.count() <= MOST_QUERIES
    small = F.broadcast if few_queries else lambda x: x
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    wanted = asked.select("term").distinct()
    first = [r["term"] for r in wanted.orderBy("term").limit(MOST_TERMS + 1).collect()]
    if len(first) <= MOST_TERMS:
        hits = postings(documents, key, text, first)
    else:
        docs = documents.select(F.col(key), terms(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
        hits = docs.select(key, "dl", F.explode("t").alias("term")).join(small(wanted), "term").groupBy(key, "term", "dl").agg(F.count("*").cast("int").alias("tf"))
    hits = hits.checkpoint()
    totals = documents.select(F.size(terms(F.col(text))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(totals)).select("term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighed = hits.join(small(idf), "term")  # at most as many rows as query terms
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = weighed.withColumn("part", part).join(small(asked), "term").groupBy("query_id", key).agg(F.sum("part").alias("raw"))
    scored = scored.select("query_id", key, F.round("raw", 9).alias("score"))
    return top_k(scored, ["query_id"], [F.col("score").desc(), F.col(key).asc()], top)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group (the plan cuts groups before the shuffle)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def vector_top_k(vectors: DataFrame, queries: DataFrame, top: int = 10, others: bool = True) -> DataFrame:
    """Exact cosine neighbours of each query row (``vec_id``, ``embedding``) among all rows; the row
    of the query's own id is left out, unless query ids are no row ids (``others=False``).

    The stated query set is taken in blocks; a block meets each batch of vectors as one matrix
    product, a partition keeps its best ``top`` per query, and only those are merged.
    """
    blocks = -(-queries.count() // MOST_QUERIES) or 1
    if blocks > 1:  # twice as many blocks as needed, so that none is too full
        of = F.pmod(F.xxhash64("vec_id"), F.lit(2 * blocks))
        parts = [_near_block(vectors, queries.where(of == k), top, others) for k in range(2 * blocks)]
        near = parts[0]
        for p in parts[1:]:
            near = near.unionAll(p)
    else:
        near = _near_block(vectors, queries, top, others)
    return top_k(near, ["query_id"], [F.col("score").desc(), F.col("vec_id").asc()], top)


def _near_block(vectors: DataFrame, queries: DataFrame, top: int, others: bool) -> DataFrame:
    """Candidates of one block of queries: the best of each partition."""
    spec = "query_id long, vec_id long, score double"
    rows = queries.select("vec_id", "embedding").limit(2 * MOST_QUERIES + 1).collect()
    if len(rows) > 2 * MOST_QUERIES:
        raise ValueError("a block of queries is too large: query ids must be unique")
    ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
    q = _unit(np.array([r["embedding"] for r in rows], dtype=np.float64)) if rows else np.empty((0, 0))
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, qm = shared.value
        best: pd.DataFrame | None = None
        for b in batches:
            for lo in range(0, b.num_rows if len(qid) else 0, TILE):
                part = b.slice(lo, TILE)
                key = part.column(0).to_numpy(zero_copy_only=False)
                m = _unit(np.array(part.column(1).to_pylist(), dtype=np.float64))
                k = min(top + 1, len(key))
                found = []
                for q0 in range(0, len(qid), TILE):  # a tile of queries by a tile of vectors, 8 MB
                    s = np.round(qm[q0 : q0 + TILE] @ m.T, 9)
                    floor = np.partition(s, len(key) - k, axis=1)[:, len(key) - k]
                    r, c = np.nonzero(s >= floor[:, None])  # ties of the last place stay for the merge
                    found.append(pd.DataFrame({"query_id": qid[q0 + r], "vec_id": key[c], "score": s[r, c]}))
                best = _cut(pd.concat([best, *found] if best is not None else found), top + 1)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best[["query_id", "vec_id", "score"]].astype({"query_id": "int64", "vec_id": "int64", "score": "float64"}), preserve_index=False)

    near = vectors.select("vec_id", "embedding").mapInArrow(run, spec)
    return near.where("query_id <> vec_id") if others else near


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _cut(f: pd.DataFrame, k: int) -> pd.DataFrame:
    f = f.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], ignore_index=True)
    return f[f.groupby("query_id").cumcount() < k]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays with built-in functions (the reference for the matrix path)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def min_max(df: DataFrame, by: list[str], score: str, name: str) -> DataFrame:
    """Scores of a group scaled to 0..1; 1 where all are equal."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(name, F.when(hi == lo, 1.0).otherwise((F.col(score) - lo) / (hi - lo)))


def fuse(keyword: DataFrame, vector: DataFrame, key: str, alpha: float = 0.5) -> DataFrame:
    """Relative-score fusion: alpha x vector + (1 - alpha) x keyword; a missing arm counts 0."""
    k = min_max(keyword, ["query_id"], "score", "k").select("query_id", key, "k", F.col("score").alias("keyword_score"))
    v = min_max(vector, ["query_id"], "score", "v").select("query_id", key, "v", F.col("score").alias("vector_score"))
    j = k.join(v, ["query_id", key], "full")
    return j.withColumn("score", F.round(F.lit(alpha) * F.coalesce("v", F.lit(0.0)) + F.lit(1 - alpha) * F.coalesce("k", F.lit(0.0)), 9)).select("query_id", key, "keyword_score", "vector_score", "score")


def kind_weight(c: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for k, w in KIND_WEIGHT.items():
        out = F.when(c == k, w).otherwise(out)
    return out


def recency(day: Column, as_of: str, years: int = RECENCY_YEARS) -> Column:
    """1.1 for today or later, falling in a line to 0.9 at ``years``; 1 without a date."""
    age = F.datediff(F.lit(as_of).cast("date"), day) / 365.25
    line = F.when(age <= 0, RECENCY_BEST).when(age >= years, RECENCY_WORST).otherwise(RECENCY_BEST - 0.2 * age / years)
    return F.when(day.isNull(), 1.0).otherwise(line)


def rerank(results: DataFrame, as_of: str, prefer_recent: bool = True, prefer_primary: bool = True, diversity: float = DIVERSITY) -> DataFrame:
    """score x kind x recency + graph boost - penalty for each earlier hit of the document, at least
    0; then the new rank.  Input needs query_id, rank, doc_id, doc_type, effective_date, score, graph_boost."""
    earlier = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank")) - 1
    s = F.col("score")
    if prefer_primary:
        s = s * kind_weight(F.col("doc_type"))
    if prefer_recent:
        s = s * recency(F.col("effective_date"), as_of)
    s = F.greatest(F.lit(0.0), s + F.col("graph_boost") - F.lit(diversity) * F.col("__earlier"))
    out = results.withColumn("__earlier", earlier).withColumn("new_score", F.round(s, 9)).drop("__earlier")
    return out.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("new_score").desc(), "rank")))


def term_boost(query: Column, citation: Column, text: Column, boost: float = 0.1) -> Column:
    """+2 boosts for each query term in the citation, else +1 for one in the first 500 characters."""
    cite, head = F.lower(F.coalesce(citation, F.lit(""))), F.lower(F.substring(text, 1, 500))
    each = lambda t: F.when(F.contains(cite, t), 2 * boost).when(F.contains(head, t), boost).otherwise(0.0)
    return F.aggregate(F.transform(F.split(F.lower(query), " "), each), F.lit(0.0), lambda a, x: a + x)


def date_between(day: Column, lo: str | None, hi: str | None) -> Column:
    """Inclusive range; rows without a date pass."""
    cond = F.lit(True)
    if lo:
        cond = cond & (day >= F.lit(lo).cast("date"))
    if hi:
        cond = cond & (day <= F.lit(hi).cast("date"))
    return day.isNull() | cond


def matching(df: DataFrame, filters: dict[str, object] | None) -> DataFrame:
    """Equality filters from a dictionary: a list means any of its values, several keys mean all; null
    never matches, and a key without a value is no filter."""
    for name, value in (filters or {}).items():
        if value is None:
            continue
        df = df.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value))
    return df


def result_score(score: Column, distance: Column) -> Column:
    """The score of a result: its own, else 1 - distance, else 0."""
    return F.coalesce(score, 1 - distance, F.lit(0.0))


def result_source(distance: Column) -> Column:
    """Which arm a result came from: vectors report a distance."""
    return F.when(distance.isNotNull(), "vector").otherwise("keyword")


def result_counts(results: DataFrame, by: list[str], document: str, chunk: str) -> DataFrame:
    """Distinct documents and chunks of a result, and its rows."""
    return results.groupBy(*by).agg(F.countDistinct(document).alias("n_documents"), F.countDistinct(chunk).alias("n_chunks"), F.count("*").alias("n_results"))


def first_questions(queries: DataFrame, n: int | None) -> DataFrame:
    """The first n questions in id order (all without a number)."""
    return queries if n is None else queries.orderBy("query_id").limit(n)


def valid_in(day: Column, year: Column) -> Column:
    """In force by a year; rows without a date pass."""
    return day.isNull() | (F.year(day) <= year)


def with_relevance(results: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Results with their relevance, null where none was given; of several scores the greatest."""
    return results.join(scores.groupBy(*keys).agg(F.max("relevance").alias("relevance")), keys, "left")


def relevant_or_first(scored: DataFrame, threshold: float, floor: int = 10, missing: float = 0.5) -> DataFrame:
    """Rows at or above the threshold, and in any case the first ``floor`` of each query."""
    s = F.coalesce("relevance", F.lit(missing))
    w = Window.partitionBy("query_id").orderBy(F.col("relevance_").desc(), "rank")
    return scored.withColumn("relevance_", s).withColumn("position", F.row_number().over(w)).where((F.col("position") <= floor) | (F.col("relevance_") >= threshold))


def merge_subqueries(results: DataFrame, key: str, boost: float = 0.1) -> DataFrame:
    """One row per (query, item) over its sub-queries: best score, number of matches, which ones, and
    the best score plus boost x (matches - 1)."""
    g = results.groupBy("query_id", key).agg(
        F.max("score").alias("best"), F.count("*").alias("matches"), F.array_join(F.transform(F.array_sort(F.collect_set("sub_idx")), lambda x: x.cast("string")), ",").alias("matched")
    )
    return g.withColumn("score", F.round(F.col("best") + boost * (F.col("matches") - 1), 9))


def first_wins(results: DataFrame, key: str) -> DataFrame:
    """The first row of each item in the order of sub-queries and ranks."""
    w = Window.partitionBy("query_id", key).orderBy("sub_idx", "rank")
    return results.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def not_yet(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: rows whose key is not among the done."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def embedding_check(vectors: DataFrame, dimension: int) -> DataFrame:
    """Dimension, mean and population deviation of the norms, and whether the mean is near 1."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    g = vectors.select(norm.alias("norm"), (F.size("embedding") == dimension).alias("ok")).agg(
        F.count("*").alias("n"), F.bool_and("ok").alias("dimension_ok"), F.round(F.avg("norm"), 6).alias("avg_norm"), F.round(F.stddev_pop("norm"), 6).alias("std_norm")
    )
    return g.withColumn("normalized", F.abs(F.col("avg_norm") - 1) < 0.1)
