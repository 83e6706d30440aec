"""References to records that do not exist.

A reference is an orphan when no row carries the key it names, when the newest row(s) of that key
are all deleted, or when the first row of the key arrived after the reference was made.

Plan: the references' distinct non-null keys (counted map-side first, so a hot key moves as one row
per task) are left-anti-joined in effect against the parents' state; only the suspect keys that
remain are joined back to the references.  That last join is salted, because one key may hold a
third of all references.

Defined edge cases
* null and blank references refer to nothing and never appear;
* a reference whose own time is null can be missing or deleted, never "not yet";
* a parent row with a null time counts as oldest; parents with a null key are ignored;
* several parent rows at the greatest time: the key is deleted only if all of them are;
* repeated references give one row (distinct); extra columns of the inputs are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that count as a hyphen.
DASHES = r"\u2010-\u2015\u2212\u00ad\ufe58\ufe63\uff0d"
BLANKS = r"[\s\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000_]+"

#: Salts of the join back from suspect keys to references.
SALTS = 16


def _plain(c: Column) -> Column:
    """Lower case, one kind of dash, single blanks (``_`` is a blank), trimmed."""
    c = F.regexp_replace(F.lower(c), f"[{DASHES}]", "-")
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def _number(c: Column) -> Column:
    """The identifying number of a plain spelling: words and marks around it and everything from
    a parenthesis on are dropped; a spelling without digits stands for itself."""
    c = F.regexp_replace(F.regexp_replace(c, r"\(.*$", ""), r" ?- ?", "-")
    found = F.regexp_extract(c, r"[0-9][0-9a-z]*(?:[.-][0-9a-z]+)*", 0)
    return F.when(found != "", found).otherwise(F.trim(c))


def document_key(c: Column, kind: str | None = None) -> Column:
    """Spelling-free key of a document id (``kind:number``), or of a bare citation of a kind."""
    p = _plain(c)
    if kind is not None:
        key = F.concat(F.lit(f"{kind}:"), _number(p))
    else:
        head = F.trim(F.substring_index(p, ":", 1))
        rest = F.regexp_replace(p, r"^[^:]*:", "")
        key = F.when(p.contains(":"), F.concat(head, F.lit(":"), _number(rest))).otherwise(_number(p))
    return F.when(p != "", key)


def chunk_key(c: Column) -> Column:
    """Spelling-free key of a chunk id: case, blanks, ``_`` and kinds of dash do not matter."""
    p = F.regexp_replace(_plain(c), " ", "")
    return F.when(p != "", p)


def parent_state(parents: DataFrame, key: Column, seen: Column, deleted: Column) -> DataFrame:
    """One row per key: first time seen, and whether its newest row(s) still stand."""
    at = F.coalesce(seen.cast("timestamp"), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    return (
        parents.select(key.alias("ref_key"), at.alias("at"), deleted.isNull().alias("stands"))
        .where("ref_key is not null")
        .groupBy("ref_key")
        .agg(F.min("at").alias("first_seen"), F.max(F.struct("at", "stands")).getField("stands").alias("stands"))
    )


def orphan_references(refs: DataFrame, parents: DataFrame, salts: int = SALTS) -> DataFrame:
    """Orphans among ``refs(src_table, src_key, src_field, ref_value, ref_time, ref_kind, ref_key)``.

    ``parents(ref_kind, ref_key, first_seen, stands)`` comes from :func:`parent_state`.  Returns the
    columns of ``refs`` plus ``reason`` (missing, deleted, not_yet), one row per reference.
    """
    refs = refs.where("ref_key is not null")
    keys = refs.groupBy("ref_kind", "ref_key").agg(F.min("ref_time").alias("earliest"))
    missing = keys.join(parents, ["ref_kind", "ref_key"], "left_anti").select(
        "ref_kind", "ref_key", F.lit(None).cast("timestamp").alias("first_seen"), F.lit(False).alias("stands")
    )
    doubtful = keys.join(parents, ["ref_kind", "ref_key"]).where("not stands or first_seen > earliest").select("ref_kind", "ref_key", "first_seen", "stands")
    suspects = missing.unionAll(doubtful).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = refs.withColumn("salt", F.pmod(F.xxhash64("src_key", "ref_time"), F.lit(salts)).cast("int"))
    reason = (
        F.when(F.col("first_seen").isNull(), "missing")
        .when(~F.col("stands"), "deleted")
        .when(F.col("first_seen") > F.col("ref_time"), "not_yet")
    )
    return (
        salted.join(suspects, ["ref_kind", "ref_key", "salt"])
        .withColumn("reason", reason)
        .where("reason is not null")
        .select("src_table", "src_key", "src_field", "ref_value", "ref_time", "ref_kind", "ref_key", "reason")
        .distinct()
    )


def legal_references(edges: DataFrame, taas: DataFrame, chunks: DataFrame) -> DataFrame:
    """The four reference fields of the domain tables in one shape."""

    def shape(df: DataFrame, table: str, field: str, key: str, value: Column, time: str, kind: str, ref: Column) -> DataFrame:
        return df.select(
            F.lit(table).alias("src_table"),
            F.col(key).cast("string").alias("src_key"),
            F.lit(field).alias("src_field"),
            value.alias("ref_value"),
            F.col(time).cast("timestamp").alias("ref_time"),
            F.lit(kind).alias("ref_kind"),
            ref.alias("ref_key"),
        )

    v = F.col("v")
    statutes = taas.select("raw_id", "scraped_at", F.explode("metadata.statutes_cited").alias("v"))
    rules = taas.select("raw_id", "scraped_at", F.explode("metadata.rules_cited").alias("v"))
    target, parent = F.col("target_doc_id"), F.col("parent_chunk_id")
    return (
        shape(edges, "resolved_edges", "target_doc_id", "edge_id", target, "extracted_at", "document", document_key(target))
        .unionAll(shape(statutes, "raw_taas", "statutes_cited", "raw_id", v, "scraped_at", "document", document_key(v, "statute")))
        .unionAll(shape(rules, "raw_taas", "rules_cited", "raw_id", v, "scraped_at", "document", document_key(v, "rule")))
        .unionAll(shape(chunks, "legal_chunks", "parent_chunk_id", "id", parent, "chunked_at", "chunk", chunk_key(parent)))
    )


def legal_parents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    d = parent_state(documents, document_key(F.col("id")), F.col("scraped_at"), F.col("deleted_at"))
    c = parent_state(chunks, chunk_key(F.col("id")), F.col("chunked_at"), F.col("deleted_at"))
    return d.withColumn("ref_kind", F.lit("document")).unionByName(c.withColumn("ref_kind", F.lit("chunk")))


def orphan_report(refs: DataFrame, orphans: DataFrame) -> DataFrame:
    """Per table, field and month of the reference: references, orphans and the reasons."""
    by = ["src_table", "src_field", "month"]
    month = F.date_format("ref_time", "yyyy-MM").alias("month")
    alls = refs.where("ref_key is not null").groupBy("src_table", "src_field", month).agg(F.count("*").alias("n_refs"))
    bad = orphans.groupBy("src_table", "src_field", month).agg(
        F.count("*").alias("n_orphans"),
        F.count_if(F.col("reason") == "missing").alias("n_missing"),
        F.count_if(F.col("reason") == "deleted").alias("n_deleted"),
        F.count_if(F.col("reason") == "not_yet").alias("n_not_yet"),
        F.countDistinct("ref_key").alias("n_keys"),
    )
    joined = alls.alias("a").join(bad.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by], "left")
    counts = ["n_orphans", "n_missing", "n_deleted", "n_not_yet", "n_keys"]
    return joined.select(*[f"a.{c}" for c in by], "n_refs", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts])
