"""Answers and their sources: claims, verification, correction, routing, and replies of models.

Models are pluggable: a ``Completer`` maps a column of prompts to a column of replies (any Arrow UDF
or SQL expression); what surrounds it is here.  :func:`offline` is a deterministic stand-in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import text as T

Completer = Callable[[Column], Column]
#: Fixed value: the shape of a validation reply.
VALIDATION = "struct<hallucinations:array<struct<claim_text:string,hallucination_type:string,severity:double,suggested_correction:string>>,verified_claims:array<string>,overall_accuracy:double>"
DISCLAIMER = r"(?is)(?:\*\*)?(disclaimer:?.*)$"


def offline(prompt: Column) -> Column:
    """A deterministic reply: an accuracy from the prompt's length, no findings."""
    score = F.round(F.pmod(F.length(prompt), F.lit(100)) / 100, 2).cast("string")
    return F.concat(F.lit('```json\n{"hallucinations": [], "verified_claims": [], "overall_accuracy": '), score, F.lit("}\n```"))


def reply(c: Column, schema: str = VALIDATION) -> Column:
    """The JSON of a reply, code fence or not; null where it is none."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(c), schema, {"mode": "PERMISSIVE"})


def claims(answers: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """(key, position, claim, source): sentences that a source follows."""
    pattern = r"([^.!?]+[.!?])\s*\[Source:\s*([^\]]+)\]"
    pairs = F.arrays_zip(F.regexp_extract_all(answer, F.lit(pattern), F.lit(1)).alias("claim"), F.regexp_extract_all(answer, F.lit(pattern), F.lit(2)).alias("source"))
    out = answers.select(key, F.posexplode(pairs).alias("position", "__p"))
    return out.select(key, "position", F.trim("__p.claim").alias("claim"), F.trim("__p.source").alias("source"))


def source_texts(found: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Adds the chunk a claim's source names: the name itself, then as a statute, then as a rule,
    over chunk ids, document ids and citations; of several the last chunk of the key.  Where none
    fits, the document of the first chunk (by rank) that holds the source in its citation or
    document id, within the key as in :func:`verified_citations`."""
    order = F.struct("rank", "chunk_id")
    names = chunks.select(key, F.explode(F.array_distinct(F.array("chunk_id", "doc_id", "citation"))).alias("name"), "chunk_id", "rank").where("name is not null and name <> ''")
    names = names.groupBy(key, "name").agg(F.max_by("chunk_id", order).alias("source_chunk_id"))
    tries = found.select("*", F.posexplode(F.array(F.col("source"), F.concat(F.lit("statute:"), "source"), F.concat(F.lit("rule:"), "source"))).alias("tier", "name"))
    hit = tries.join(names, [key, "name"])
    part = F.coalesce(F.contains("citation", "source"), F.lit(False)) | F.coalesce(F.contains("doc_id", "source"), F.lit(False))
    listed = chunks.select(key, "chunk_id", "doc_id", "citation", "rank").where("doc_id <> ''")
    held = found.join(listed, key).where(part).groupBy(key, "position").agg(F.min_by("doc_id", order).alias("name")).join(names, [key, "name"])
    first = Window.partitionBy(key, "position").orderBy("tier")
    hit = hit.select(key, "position", "tier", "source_chunk_id").unionByName(held.select(key, "position", F.lit(3).alias("tier"), "source_chunk_id"))
    best = hit.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(key, "position", "source_chunk_id")
    return found.join(best, [key, "position"], "left")


def verified_citations(cited: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """The first chunk (by rank) that a citation matches by any rule: part of its citation, the same
    section, the same base section, or the section within the chunk's id.

    Chunks are at most a handful per key (an answer's sources), so the comparison stays within the
    key: an equi-join on the key with a residual predicate.
    """
    section, theirs = T.section_number(F.col("citation_text")), T.section_number(F.col("chunk_citation"))
    base = lambda c: F.regexp_extract(c, r"^([\d.]+)", 1)
    c = cited.withColumn("section", section).withColumn("base", base(section))
    k = chunks.select(key, "chunk_id", "rank", F.col("citation").alias("chunk_citation")).withColumn("chunk_section", theirs)
    match = (
        F.contains(F.lower("chunk_citation"), F.lower("citation_text"))
        | F.coalesce(F.contains("chunk_section", "section"), F.lit(False))
        | F.coalesce((F.col("base") != "") & (F.col("base") == base(F.col("chunk_section"))), F.lit(False))
        | F.coalesce(F.contains("chunk_id", "section"), F.lit(False))
        | F.coalesce((F.col("base") != "") & F.contains("chunk_id", "base"), F.lit(False))
    )
    hits = c.join(k, key).where(match).groupBy(key, "position").agg(F.min_by("chunk_id", F.struct("rank", "chunk_id")).alias("chunk_id"))
    return cited.join(hits, [key, "position"], "left").withColumn("verified", F.col("chunk_id").isNotNull())


def simple_corrections(answer: Column, findings: Column) -> Column:
    """struct<text, corrected>: of each finding with a suggestion and severity below 0.5 the first
    occurrence in the text is replaced, in order."""
    zero = F.struct(answer.alias("text"), F.lit(0).alias("corrected"))

    def step(acc: Column, h: Column) -> Column:
        at = F.call_function("locate", h["claim_text"], acc["text"])
        ok = h["suggested_correction"].isNotNull() & (h["suggested_correction"] != "") & (h["severity"] < 0.5) & (at > 0)
        return F.struct(
            F.when(ok, F.overlay(acc["text"], h["suggested_correction"], at, F.length(h["claim_text"]))).otherwise(acc["text"]).alias("text"),
            (acc["corrected"] + ok.cast("int")).alias("corrected"),
        )

    return F.aggregate(findings, zero, step)


def confidence_change(n: Column) -> Column:
    return F.greatest(F.lit(-0.1) * n, F.lit(-0.3))


def disclaimer(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, DISCLAIMER, 1))


def context_block(chunks: DataFrame, key: str, most: int = 10) -> DataFrame:
    """The numbered context of an answer from its first chunks, in order."""
    one = F.concat(
        F.lit("--- Document "), F.col("rank").cast("string"), F.lit(" ("), F.upper(F.coalesce("doc_type", F.lit("unknown"))), F.lit(") ---\nCitation: "),
        F.coalesce("citation", F.concat(F.lit("Source "), F.col("rank").cast("string"))), F.lit("\nEffective Date: "), F.coalesce(F.col("effective_date").cast("string"), F.lit("Not specified")),
        F.lit("\nAncestry: "), F.coalesce("ancestry", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")),
    )
    rows = chunks.where(F.col("rank") <= most).select(key, "rank", F.regexp_replace(one, r"^\s+|\s+$", "").alias("block"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"))


def routes(state: DataFrame, most_iterations: int = 3) -> DataFrame:
    """Next steps as columns: expand the graph, retrieve again, and what to do after validation."""
    return state.select(
        "*",
        (F.col("n_results") > 0).alias("expand_graph"),
        F.when(F.col("needs_more") & (F.col("iteration") < most_iterations), "retrieve").otherwise("synthesize").alias("after_check"),
        F.when(F.col("passed"), "end").when(F.col("needs_regeneration") & (F.col("attempts") < most_iterations), "regenerate").when(F.col("needs_correction"), "correct").otherwise("end").alias("after_validation"),
        ((F.col("confidence") >= 0.85) & ~F.col("complex")).alias("skip_validation"),
    )


def agent_loop(state: DataFrame, step: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame], Column], most_iterations: int = 3) -> DataFrame:
    """Bounded loop over a whole batch of questions: finished ones are set aside, the rest go round
    again; lineage is cut after each round."""
    from statloom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(state.sparkSession)
    finished = None
    for _ in range(most_iterations):
        state = step(state).checkpoint()
        ready = state.where(done(state))
        finished = ready if finished is None else finished.unionByName(ready)
        state = state.where(~done(state))
    return finished.unionByName(state)
