"""Citations: extraction with positions, resolution in tiers, edges and their statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import text as T

#: Characters of context on each side of a citation.
WINDOW = 75

_PY = {
    "statute": re.compile(T.STATUTE.replace(r"\x{a0}", r"\xa0")),
    "rule": re.compile(T.RULE.replace(r"\x{a0}", r"\xa0")),
    "case": re.compile(T.CASE + r"(?:\s*,\s*\d+)?(?:\s*\(([^)]+?)\s*(\d{4})\))?"),
    "lexis": re.compile(T.LEXIS),
    "chapter": re.compile(T.CHAPTER + r"(?:\s*[-–]\s*(\d{1,3}))?"),
}


def spans(text: str) -> list[tuple[str, str, str, str, int, int]]:
    """Citations of a text by kind, first occurrence of each normal form, with their offsets in the
    cleaned text (line breaks after ``s.`` taken out), which the context is cut from as well."""
    out = []
    for kind, pattern in _PY.items():
        seen = set()
        for m in pattern.finditer(text):
            g = m.groups()
            if kind in ("statute", "rule"):
                section = (g[0] or g[2]) if kind == "statute" else (g[0] or g[2]).upper()
                normal = section + (g[1] if g[0] else g[3] or "").lower()
            elif kind == "case":
                section, normal = None, f"{g[0]} {g[1]} {g[2]}"
            elif kind == "lexis":
                section, normal = None, f"{g[0]} {g[1]} {g[2]}"
            else:
                section, normal = g[0], f"chapter {g[0]}" + (f"-{g[1]}" if g[1] else "")
            if normal not in seen:
                seen.add(normal)
                out.append(("case" if kind == "lexis" else kind, m.group(), normal, section, m.start(), m.end()))
    return out


_BROKEN_S = re.compile(r"s\.\s*\n\s*")


def extract(chunks: DataFrame, keep: list[str], text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per citation: ``keep`` columns, kind, raw and normal form, section, offsets, context."""
    names = [c for c in keep if c not in {"kind", "raw", "normalized", "section", "start_pos", "end_pos", "context"}]
    source = chunks.select(*names, F.col(text).alias("__text")).where("__text is not null")
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    fields = [StructField(n, StringType()) for n in ("kind", "raw", "normalized", "section")]
    fields += [StructField(n, IntegerType()) for n in ("start_pos", "end_pos")] + [StructField("context", StringType())]
    schema = StructType([source.schema[c] for c in names] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            cols: list[list] = [[] for _ in fields]
            for r, t in enumerate(b.column(len(names)).to_pylist()):
                t = _BROKEN_S.sub("s. ", t)
                for found in spans(t):
                    rows.append(r)
                    for c, v in zip(cols, (*found, t[max(0, found[4] - window) : found[5] + window])):
                        c.append(v)
            kept = b.take(pa.array(rows, pa.int64()))
            types = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([kept.column(i) for i in range(len(names))] + [pa.array(c, t) for c, t in zip(cols, types)], names=schema.names)

    return source.mapInArrow(run, schema)


def without_self_references(cited: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Drops citations of the citing document's own section (statutes and rules)."""
    own = F.regexp_replace(F.col(doc_id), r"^[^:]*:", "")
    return cited.where(~(F.col("kind").isin("statute", "rule") & F.coalesce(F.col("section") == own, F.lit(False))))


def document_index(chunks: DataFrame) -> DataFrame:
    """Per document with chunks: its parent chunk (the first id that ends in ``:0``, else the first)
    and, for cases, the normal form of its citation (after the first comma).  Of several documents of
    one citation :func:`resolve` takes the last in id order (rows of a table have no order of writing)."""
    after = F.regexp_extract("citation", r"^[^,]*,(.*)$", 1)
    return chunks.groupBy("doc_id").agg(
        F.min(F.struct((~F.col("id").endswith(":0")).alias("other"), "id")).getField("id").alias("parent_chunk"),
        F.max("doc_type").alias("doc_type"),
        F.max(F.when((F.col("doc_type") == "case") & F.col("citation").contains(","), T.normal_case_citation(after))).alias("case_key"),
    )


#: Copies of a resolved key, so that a section that a third of all citations name is joined by several tasks.
SALTS = 8


def resolve(cited: DataFrame, index: DataFrame) -> DataFrame:
    """Adds target_doc_id, target_chunk_id and confidence: exact section 1.0, without subsection 0.8,
    case citation 0.9; chapters never resolve.

    The distinct (kind, section, normal form) keys are resolved once, trying their candidate names in
    one equi-join with the index, of which the best tier wins; then the citations, with their texts,
    are joined to them, salted.
    """
    names = ["kind", "section", "normalized"]
    keys = cited.select(*names).distinct().withColumn("__key", F.to_json(F.struct(*names)))
    base = F.substring_index("section", "(", 1)
    tiers = F.array_compact(
        F.array(
            F.when(F.col("kind").isin("statute", "rule"), F.struct(F.concat("kind", F.lit(":"), "section").alias("key"), F.lit(1.0).alias("confidence"))),
            F.when(F.col("kind").isin("statute", "rule") & F.col("section").contains("("), F.struct(F.concat("kind", F.lit(":"), base).alias("key"), F.lit(0.8).alias("confidence"))),
            F.when(F.col("kind") == "case", F.struct(F.concat(F.lit("cite:"), T.normal_case_citation(F.col("normalized"))).alias("key"), F.lit(0.9).alias("confidence"))),
        )
    )
    targets = index.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("target_doc_id"), F.col("parent_chunk").alias("target_chunk_id")).unionAll(
        index.where("case_key is not null").groupBy(F.concat(F.lit("cite:"), "case_key").alias("key")).agg(F.max("doc_id").alias("target_doc_id"), F.max_by("parent_chunk", "doc_id").alias("target_chunk_id"))
    )
    found = keys.select("__key", F.inline_outer(tiers)).join(targets, "key")
    best = found.groupBy("__key").agg(F.max_by(F.struct("target_doc_id", "target_chunk_id", "confidence"), F.struct("confidence", "key")).alias("t"))
    copies = best.select("__key", "t.*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in cited.columns]), F.lit(SALTS)).cast("int")
    out = cited.withColumn("__key", F.to_json(F.struct(*names))).withColumn("__salt", salt).join(copies, ["__key", "__salt"], "left").drop("__key", "__salt")
    return out.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def citation_graph(chunks: DataFrame) -> DataFrame:
    """Extract, drop self references, classify, resolve: one row per citation of a chunk."""
    cited = without_self_references(extract(chunks, ["id", "doc_id", "doc_type"]))
    typed = cited.withColumn("relation_type", T.relation_type(F.col("context"), F.col("doc_type")))
    index = document_index(chunks)
    return resolve(typed.withColumnRenamed("doc_type", "source_doc_type"), index)


def confident(edges: DataFrame, least: float = 0.5) -> DataFrame:
    """Edges of at least this confidence; without one they are dropped."""
    return edges.where(F.col("confidence") >= least)


def resolution_report(graph: DataFrame) -> DataFrame:
    """Resolved and unresolved citations by kind and by the citing document's kind."""
    return graph.groupBy("kind", "source_doc_type").agg(F.count("target_doc_id").alias("n_resolved"), F.count_if(F.col("target_doc_id").isNull()).alias("n_unresolved"))


def best_edges(edges: DataFrame, order: str = "edge_id") -> DataFrame:
    """Of each (source, target, relation) the edge of highest confidence, the first on ties."""
    w = Window.partitionBy("source_doc_id", "target_doc_id", "relation_type").orderBy(F.col("confidence").desc(), order)
    return edges.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def delivered_once(edges: DataFrame) -> DataFrame:
    """The latest load of each edge."""
    w = Window.partitionBy("edge_id").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("extracted_at").desc_nulls_last(), F.col("target_doc_id").asc_nulls_last())
    return edges.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").otherwise("low")


def edge_statistics(edges: DataFrame) -> DataFrame:
    """Counts by relation, source kind, target kind and confidence band in one pass of grouping sets."""
    kind = lambda c: F.lower(F.trim(F.substring_index(c, ":", 1)))
    rows = edges.select(
        "relation_type",
        kind("source_doc_id").alias("source_type"),
        kind("target_doc_id").alias("target_type"),
        confidence_band(F.col("confidence")).alias("band"),
    )
    cols = ["relation_type", "source_type", "target_type", "band"]
    return rows.groupingSets([[F.col(c)] for c in cols], *[F.col(c) for c in cols]).agg(F.count("*").alias("n"), F.grouping_id().alias("gid")).select(
        F.expr("CASE gid WHEN 7 THEN 'relation' WHEN 11 THEN 'source' WHEN 13 THEN 'target' ELSE 'band' END").alias("by"),
        F.expr("CASE gid WHEN 7 THEN relation_type WHEN 11 THEN source_type WHEN 13 THEN target_type ELSE band END").alias("value"),
        "n",
    )
