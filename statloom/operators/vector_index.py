"""An inverted-file index over vectors, for searches that need not be exact.

Cells are the centroids of a spherical k-means over a bounded sample; every vector is indexed, under
its nearest cell, in a table partitioned by cell.  A search reads only the cells nearest to its
queries (partition pruning) and scores their rows exactly.  How many cells a query probes is chosen
by measured recall: :func:`tuned_probes` compares with brute force over all rows.

Defined edge cases: vectors that are null, of another length, or zero are indexed under cell -1,
which every search reads; repeated rows are results each; an empty table gives an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.operators import retrieval as R
from statloom.operators.retrieval import TILE, _cut, _unit, top_k

#: Vectors that the cells are fitted on, rounds of fitting, rows of a cell aimed at, most cells.
SAMPLE, ROUNDS, CELL_ROWS, MOST_CELLS = 20_000, 8, 1_000, 4_096
#: Queries that the number of probes is measured on, and the recall aimed at.
MEASURED, RECALL = 200, 0.95


@dataclass
class Index:
    path: str
    cells: np.ndarray
    probes: int = 1

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("vec_id long, embedding array<float>, cell int").parquet(self.path)


def fit_cells(vectors: DataFrame, dimension: int, n: int | None = None, seed: int = 42) -> np.ndarray:
    """Unit centroids from at most ``SAMPLE`` vectors (those of the least hashes)."""
    usable = vectors.where(F.size("embedding") == dimension)
    n = usable.count() if n is None else n
    rows = usable.select("embedding", F.xxhash64(F.lit(seed), "vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(SAMPLE).collect()
    k = min(MOST_CELLS, max(1, n // CELL_ROWS, int(n**0.5) // 2), len(rows))
    if not k:
        return np.empty((0, dimension))
    m = _unit(np.array([r["embedding"] for r in rows], dtype=np.float64))
    c = m[np.random.default_rng(seed).choice(len(m), k, replace=False)]
    for _ in range(ROUNDS):
        of = (m @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, m)
        held = np.linalg.norm(sums, axis=1) > 0
        c[held] = _unit(sums[held])
    return c


def build(vectors: DataFrame, dimension: int, path: str, seed: int = 42) -> Index:
    """Writes the index of all rows of (vec_id, embedding)."""
    cells = fit_cells(vectors, dimension, seed=seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = np.full(b.num_rows, -1, dtype=np.int32)
            values = b.column(1).to_pylist()
            good = [i for i, v in enumerate(values) if v is not None and len(v) == dimension and None not in v and any(v)]
            for lo in range(0, len(good) if len(cells) else 0, TILE):
                part = good[lo : lo + TILE]
                of[part] = (_unit(np.array([values[i] for i in part], dtype=np.float64)) @ cells.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(of, pa.int32())], names=["vec_id", "embedding", "cell"])

    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, "vec_id long, embedding array<float>, cell int")
    rows.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(path)  # a hot cell is several files
    return Index(path, cells)


def search(spark: SparkSession, index: Index, queries: DataFrame, top: int = 10, others: bool = True, probes: int | None = None) -> DataFrame:
    """Near neighbours of each query row (``vec_id``, ``embedding``): as :func:`retrieval.vector_top_k`,
    among the rows of the query's nearest cells.  Up to ``MOST_QUERIES`` queries a call."""
    rows = queries.select("vec_id", "embedding").limit(R.MOST_QUERIES + 1).collect()
    if len(rows) > R.MOST_QUERIES:
        raise ValueError(f"search takes up to {R.MOST_QUERIES} queries a call; send more in blocks")
    ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
    k = min(index.probes if probes is None else probes, len(index.cells))
    spec = "query_id long, vec_id long, score double"
    if not len(rows):
        return spark.createDataFrame([], f"{spec}, rank int")
    q = _unit(np.array([r["embedding"] for r in rows], dtype=np.float64))
    near = np.argsort(-(q @ index.cells.T), axis=1)[:, :k] if k else np.empty((len(q), 0), dtype=int)
    asking: dict[int, np.ndarray] = {int(c): np.nonzero((near == c).any(axis=1))[0] for c in np.unique(near)}
    asking[-1] = np.arange(len(q))
    shared = spark.sparkContext.broadcast((ids, q, asking))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, qm, of = shared.value
        best: pd.DataFrame | None = None
        for b in batches:
            cells = b.column(2).to_numpy(zero_copy_only=False)
            found = []
            for cell in np.unique(cells):
                at = np.nonzero(cells == cell)[0]
                for lo in range(0, len(at), TILE):
                    part = b.take(pa.array(at[lo : lo + TILE]))
                    values = part.column(1).to_pylist()
                    good = [i for i, v in enumerate(values) if v is not None and len(v) == qm.shape[1] and None not in v]
                    if not good:
                        continue
                    keys = part.column(0).to_numpy(zero_copy_only=False)[good]
                    m = _unit(np.array([values[i] for i in good], dtype=np.float64))
                    who = of[int(cell)]
                    for q0 in range(0, len(who), TILE):
                        s = np.round(qm[who[q0 : q0 + TILE]] @ m.T, 9)
                        n = min(top + 1, len(keys))
                        floor = np.partition(s, len(keys) - n, axis=1)[:, len(keys) - n]
                        r, c = np.nonzero(s >= floor[:, None])
                        found.append(pd.DataFrame({"query_id": qid[who[q0 + r]], "vec_id": keys[c], "score": s[r, c]}))
            if found:
                best = _cut(pd.concat([best, *found] if best is not None else found), top + 1)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best[["query_id", "vec_id", "score"]].astype({"query_id": "int64", "vec_id": "int64", "score": "float64"}), preserve_index=False)

    probed = index.read(spark).where(F.col("cell").isin([int(c) for c in asking]))
    hits = probed.select("vec_id", "embedding", "cell").mapInArrow(run, spec)
    if others:
        hits = hits.where("query_id <> vec_id")
    return top_k(hits, ["query_id"], [F.col("score").desc(), F.col("vec_id").asc()], top)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and the share of the exact results that were found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("n_queries"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("recall"))


def tuned_probes(spark: SparkSession, index: Index, vectors: DataFrame, top: int = 10, target: float = RECALL, seed: int = 42) -> Index:
    """The index with the least number of probes (doubled from 1) that reaches the recall on a bounded
    sample of its own vectors, measured against brute force over all rows."""
    asked = vectors.where("embedding is not null").orderBy(F.xxhash64(F.lit(seed + 1), "vec_id"), "vec_id").limit(MEASURED)
    exact = R.vector_top_k(vectors, asked, top).checkpoint()
    probes = 1
    while probes < len(index.cells) and recall(search(spark, index, asked, top, probes=probes), exact).first()["recall"] < target:
        probes *= 2
    return Index(index.path, index.cells, min(probes, max(1, len(index.cells))))
