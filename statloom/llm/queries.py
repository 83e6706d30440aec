"""Queries of the training-text operators, each over its whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import budget, mixing, mojibake, packing, residue, scans, split
from statloom.llm.tokens import with_tokens
from statloom.session import ensure_checkpoint_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def _restored(spark: SparkSession, d: str) -> DataFrame:
    both = [table(spark, d, t).select(F.lit(t).alias("src_table"), "raw_id", F.lit("en").alias("lang"), "text") for t in ("raw_statutes", "raw_taas")]
    texts = both[0].unionByName(both[1])
    return mojibake.restore_texts(texts, mojibake.fit(texts, table(spark, d, "documents").select("lang", "text")), ["src_table", "raw_id"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d).select("src_table", "raw_id").distinct()


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.find_scans(table(spark, d, "raw_taas").select("raw_id", "text"), ["raw_id"]).distinct()


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair_scans(table(spark, d, "raw_taas").select("raw_id", "pdf_path", "text"), ["raw_id", "pdf_path"])


def p4_token_budget(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return budget.token_budget(t("documents"), t("graph_chunks"), t("graph_documents"), t("legal_chunks"))


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each part of the budget, and how many rows of documents stand for a text of their own."""
    b = p4_token_budget(spark, d).groupBy("part").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_counted").alias("n"))
    return b.select("part", "n_rows", F.when(F.col("part") == "documents", F.col("n")).alias("n_counted"))


def p4_chunk_verdicts(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return budget.chunk_budget(t("graph_chunks"), t("graph_documents"), t("legal_chunks"))


def _pieces(spark: SparkSession, d: str, limit: str, unit: str, keep: list[str], distinct: bool) -> DataFrame:
    capacity, overlap = split.size_limit(table(spark, d, "size_limits"), limit)
    chunks = table(spark, d, "legal_chunks")
    if distinct:  # an id always has the same text
        chunks = chunks.where(F.length("text") > (capacity if unit == "characters" else 0)).dropDuplicates(["id"])
    chunks = chunks.withColumnRenamed("id", "chunk_id")
    return split.split_oversized(chunks, capacity, overlap, keep, unit=unit)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, "split_chunk", "characters", ["chunk_id"], False).select("chunk_id").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, "split_chunk", "characters", ["chunk_id", "doc_id", "subsection_path"], True)


def p5_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk's pieces without their overlaps, joined, as a digest; and whether pieces keep the limit and the overlap."""
    capacity, overlap = split.size_limit(table(spark, d, "size_limits"), "split_chunk")
    pieces = p5_pieces(spark, d)
    own = F.when(F.col("piece") == 0, F.col("piece_text")).otherwise(F.substring("piece_text", overlap + 1, capacity))
    parts = F.array_sort(F.collect_list(F.struct("piece", own.alias("own"), "start", "end")))  # of one text
    whole = pieces.groupBy("chunk_id").agg(parts.alias("p"), F.max("size").alias("longest"))
    laps = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.element_at("p", i)["end"] - F.element_at("p", i + 1)["start"] == overlap)
    return whole.select("chunk_id", F.md5(F.concat_ws("", F.col("p.own"))).alias("digest"), (F.col("longest") <= capacity).alias("fits"), laps.alias("overlaps"))


def p5_pieces_tokens(spark: SparkSession, d: str) -> DataFrame:
    pieces = _pieces(spark, d, "split_chunk_tokens", "tokens", ["chunk_id", "doc_id", "subsection_path"], True)
    stored = table(spark, d, "graph_chunks").groupBy(F.col("id").alias("chunk_id")).agg(F.max("token_count").alias("stored_tokens"))
    return pieces.join(stored, "chunk_id", "left")


def p6_pack_small(spark: SparkSession, d: str) -> DataFrame:
    capacity, _ = split.size_limit(table(spark, d, "size_limits"), "pack_small")
    return packing.pack_documents(table(spark, d, "documents"), capacity)


def p6_pack_large(spark: SparkSession, d: str) -> DataFrame:
    capacity, _ = split.size_limit(table(spark, d, "size_limits"), "pack_large")
    return packing.pack_documents(table(spark, d, "documents"), capacity)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    sized = with_tokens(table(spark, d, "documents"), keep=["doc_id"]).checkpoint()  # numbers only, used twice
    limits = [split.size_limit(table(spark, d, "size_limits"), name)[0] for name in ("pack_small", "pack_large")]
    small, large = (packing.fill_report(packing.pack_sized(sized, n)) for n in limits)
    return small.unionByName(large)


def p6_placed(spark: SparkSession, d: str) -> DataFrame:
    """Per limit: items placed, items not placed exactly once, containers too full or of another sum than they say."""
    ensure_checkpoint_dir(spark)
    sized = with_tokens(table(spark, d, "documents"), keep=["doc_id"]).checkpoint()
    out = None
    for name in ("pack_small", "pack_large"):
        packed = packing.pack_sized(sized, split.size_limit(table(spark, d, "size_limits"), name)[0]).checkpoint()
        items = packed.groupBy("doc_id").agg(F.sum("tokens").alias("placed")).join(sized, "doc_id", "full")
        items = items.agg(F.count("placed").alias("n_items"), F.count_if(~F.col("placed").eqNullSafe(F.col("tokens"))).alias("n_wrong"))
        held = packed.groupBy("container_id").agg(F.sum("tokens").alias("held"), F.max("container_tokens").alias("says"), F.max("capacity").alias("capacity"))
        held = held.agg(F.count_if((F.col("held") > F.col("capacity")) | (F.col("held") != F.col("says"))).alias("n_bad_containers"))
        one = items.join(held).select(F.lit(name).alias("limit_name"), "n_items", "n_wrong", "n_bad_containers")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(spark, table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_blocks(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_spans(spark, table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per target source: is the reached share within a block of what was wanted (or of what it may give),
    and is no record used too often?"""
    records, plan = mixing.mix(spark, table(spark, d, "documents"), table(spark, d, "mix_targets"))
    r = mixing.share_report(records, plan)
    off = F.abs(F.col("used_tokens") - F.least("wanted", F.col("available") * F.col("max_repeats")))
    return r.select("source", "target_share", (off <= mixing.BLOCK_TOKENS).alias("share_met"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(*mixing.mix(spark, table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents"), ["doc_id"]).select("doc_id").distinct()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    found = residue.find_residue(table(spark, d, "documents"), ["doc_id", "source", "lang"])
    return found.select("doc_id", "source", "lang", "residue", "example")


def p8_clean_corpus(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents"), [], clean=True)


def p8_partition(spark: SparkSession, d: str) -> DataFrame:
    """Documents with residue and without, together, and those that are both or neither."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = residue.find_residue(docs, ["doc_id"]).select("doc_id", F.lit(1).alias("n"))
    clean = residue.find_residue(docs, [], clean=True).select("doc_id", F.lit(1).alias("n"))
    each = found.unionAll(clean).unionAll(docs.select("doc_id", F.lit(0).alias("n"))).groupBy("doc_id").agg(F.sum("n").alias("n"))
    return each.agg(F.count("*").alias("n_documents"), F.count_if(F.col("n") != 1).alias("n_wrong"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_restored, p3_found, p3_repaired, p4_token_budget, p4_coverage, p4_chunk_verdicts, p5_found, p5_pieces, p5_rejoined, p5_pieces_tokens, p6_pack_small, p6_pack_large, p6_fill, p6_placed, p7_mix, p7_blocks, p7_kept, p7_shares, p8_found, p8_report, p8_clean_corpus, p8_partition)
}

SQL: dict[str, str] = {
    "p4_coverage": "SELECT 'documents' AS part, count(*) AS n_rows, count(DISTINCT text) + count(*) FILTER (text IS NULL) AS n_counted FROM documents UNION ALL SELECT 'chunks', count(DISTINCT id), NULL FROM graph_chunks",
    "p8_partition": "SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS n_wrong FROM documents",
    "p5_found": "SELECT DISTINCT id AS chunk_id FROM legal_chunks WHERE length(text) > (SELECT capacity FROM size_limits WHERE limit_name = 'split_chunk')",
    "p5_rejoined": "SELECT id AS chunk_id, md5(any_value(text)) AS digest, true AS fits, true AS overlaps FROM legal_chunks WHERE length(text) > (SELECT capacity FROM size_limits WHERE limit_name = 'split_chunk') GROUP BY id",
    "p6_placed": "SELECT limit_name, (SELECT count(*) FROM documents) AS n_items, CAST(0 AS BIGINT) AS n_wrong, CAST(0 AS BIGINT) AS n_bad_containers FROM size_limits WHERE limit_name IN ('pack_small', 'pack_large')",
    "p7_kept": "SELECT source, target_share, true AS share_met, true AS repeats_kept FROM mix_targets",
}
