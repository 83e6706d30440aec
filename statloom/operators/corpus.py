"""From raw records to one corpus: normalisation, union, statistics and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("statute", "rule", "taa", "case")
# The parts of a citation that an ancestry path leaves out.
CITATION_PREFIX = {"statute": "Fla. Stat. ", "rule": "Fla. Admin. Code R. ", "taa": "Fla. DOR ", "case": ""}
ANCESTRY_ROOT = {"statute": "Florida Statutes", "rule": "Florida Administrative Code", "taa": "Florida DOR Technical Assistance Advisements", "case": "Florida Case Law"}


def _or(value: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), default)


def statutes_to_documents(raw: DataFrame) -> DataFrame:
    """One document per raw statute with a section; parent is the chapter."""
    m, section = "metadata", F.col("metadata.section")
    return raw.where(section != "").select(
        F.concat(F.lit("statute:"), section).alias("id"),
        F.lit("statute").alias("doc_type"),
        _or(F.col(f"{m}.section_name"), F.concat(F.lit("Section "), section)).alias("title"),
        F.concat(F.lit("Fla. Stat. § "), section).alias("full_citation"),
        "text",
        F.col(f"{m}.effective_date").alias("effective_date"),
        "source_url",
        F.when(F.col(f"{m}.chapter").isNotNull() & (F.col(f"{m}.chapter") != 0), F.concat(F.lit("statute:chapter_"), F.col(f"{m}.chapter").cast("string"))).alias("parent_id"),
        F.array().cast("array<string>").alias("cites_statutes"),
        F.array().cast("array<string>").alias("cites_rules"),
        "scraped_at",
        "raw_id",
    )


def taas_to_documents(raw: DataFrame) -> DataFrame:
    """One document per raw advisement with a number; blanks of the number become ``_``."""
    m, number = "metadata", F.col("metadata.taa_number")
    return raw.where(number != "").select(
        F.concat(F.lit("taa:"), F.replace(number, F.lit(" "), F.lit("_"))).alias("id"),
        F.lit("taa").alias("doc_type"),
        _or(F.col(f"{m}.title"), F.concat(F.lit("TAA "), number)).alias("title"),
        F.concat(F.lit("Fla. DOR "), number).alias("full_citation"),
        "text",
        F.col(f"{m}.issue_date").alias("effective_date"),
        "source_url",
        F.lit(None).cast("string").alias("parent_id"),
        F.coalesce(F.col(f"{m}.statutes_cited"), F.array().cast("array<string>")).alias("cites_statutes"),
        F.coalesce(F.col(f"{m}.rules_cited"), F.array().cast("array<string>")).alias("cites_rules"),
        F.col(f"{m}.tax_type").alias("tax_type"),
        "scraped_at",
        "raw_id",
    )


def rules_to_documents(raw: DataFrame) -> DataFrame:
    """One document per raw rule with a number; cited statutes are the distinct union of three lists, sorted."""
    m, number = "metadata", F.col("metadata.rule_number")
    lists = [F.coalesce(F.col(f"{m}.{c}"), F.array().cast("array<string>")) for c in ("rulemaking_authority", "law_implemented", "references_statutes")]
    return raw.where(number != "").select(
        F.concat(F.lit("rule:"), number).alias("id"),
        F.lit("rule").alias("doc_type"),
        _or(F.col(f"{m}.title"), F.concat(F.lit("Rule "), number)).alias("title"),
        F.concat(F.lit("Fla. Admin. Code R. "), number).alias("full_citation"),
        "text",
        F.col(f"{m}.effective_date").alias("effective_date"),
        "source_url",
        F.when(F.col(f"{m}.chapter") != "", F.concat(F.lit("rule:chapter_"), F.col(f"{m}.chapter"))).alias("parent_id"),
        F.array_sort(F.array_distinct(F.concat(*lists))).alias("cites_statutes"),
        F.array().cast("array<string>").alias("cites_rules"),
        "scraped_at",
    )


def cases_to_documents(raw: DataFrame) -> DataFrame:
    """One document per raw case with a cluster id; cited case numbers become case ids."""
    m, number = "metadata", F.col("metadata.cluster_id")
    return raw.where(number.isNotNull() & (number != 0)).select(
        F.concat(F.lit("case:"), number.cast("string")).alias("id"),
        F.lit("case").alias("doc_type"),
        _or(F.col(f"{m}.case_name"), F.concat(F.lit("Case "), number.cast("string"))).alias("title"),
        _or(F.col(f"{m}.case_name"), F.lit("")).alias("full_citation"),
        F.col("opinion_text").alias("text"),
        F.col(f"{m}.date_filed").alias("effective_date"),
        "source_url",
        F.lit(None).cast("string").alias("parent_id"),
        F.coalesce(F.col(f"{m}.statutes_cited"), F.array().cast("array<string>")).alias("cites_statutes"),
        F.transform(F.coalesce(F.col(f"{m}.cases_cited"), F.array().cast("array<int>")), lambda x: F.concat(F.lit("case:"), x.cast("string"))).alias("cites_cases"),
        "scraped_at",
    )


def consolidate(*parts: DataFrame) -> DataFrame:
    """UNION ALL in the given order of kinds."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def latest_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The newest row of each key (window group limit in the plan, no self join)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ancestry(doc_type: Column, citation: Column, title: Column, chapter: Column, extra: Column) -> Column:
    """``root > optional part > chapter > citation`` by kind; the citation for other kinds."""
    out = citation
    for kind in KINDS:
        last = title if kind == "case" else F.replace(citation, F.lit(CITATION_PREFIX[kind]), F.lit("Rule " if kind == "rule" else ""))
        parts = [F.lit(ANCESTRY_ROOT[kind])]
        if kind in ("statute", "rule"):
            parts.append(F.when(chapter != "", F.concat(F.lit("Chapter "), chapter)))
        else:
            parts.append(F.nullif(extra, F.lit("")))
        out = F.when(doc_type == kind, F.concat_ws(" > ", *parts, last)).otherwise(out)
    return out


def with_paths(documents: DataFrame, chapter: Column, extra: Column) -> DataFrame:
    """Documents as the chunker takes them: with their ancestry and their citation."""
    path = ancestry(F.col("doc_type"), F.col("full_citation"), F.col("title"), F.coalesce(chapter, F.lit("")), F.coalesce(extra, F.lit("")))
    return documents.select("id", "doc_type", "text", path.alias("ancestry"), F.col("full_citation").alias("citation"), "effective_date")


def corpus_counts(documents: DataFrame) -> DataFrame:
    """Rows by kind and in all (null kind), in one pass."""
    return documents.rollup("doc_type").agg(F.count("*").alias("n"))


def length_statistics(documents: DataFrame) -> DataFrame:
    n = F.length("text")
    return documents.groupBy("doc_type").agg(
        F.count("*").alias("n"),
        F.floor(F.sum(n) / F.count("*")).alias("avg_length"),
        F.min(n).alias("min_length"),
        F.max(n).alias("max_length"),
        F.sum(F.size("cites_statutes").cast("long")).alias("n_cites_statutes"),
        F.sum(F.size("cites_rules").cast("long")).alias("n_cites_rules"),
    )


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """By level and kind: token average, bounds and the four-bin histogram with whole percentages."""
    t = F.col("token_count")
    bins = {"lt_500": t < 500, "lt_1000": (t >= 500) & (t < 1000), "lt_2000": (t >= 1000) & (t < 2000), "ge_2000": t >= 2000}
    aggs = [F.count_if(cond).alias(name) for name, cond in bins.items()]
    share = [F.floor(F.count_if(cond) * 100 / F.greatest(F.count("token_count"), F.lit(1))).alias(f"pct_{name}") for name, cond in bins.items()]
    return chunks.groupBy("level", "doc_type").agg(F.count("*").alias("n"), F.round(F.avg(t), 6).alias("avg_tokens"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"), *aggs, *share)


def audit_statutes(raw: DataFrame, short: int = 50) -> DataFrame:
    """Issues of raw statutes: one row per issue with its count and share."""
    dup = F.row_number().over(Window.partitionBy(F.col("metadata.section")).orderBy("raw_id")) > 1
    issues = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("metadata.chapter_name"), F.lit("")) == "", F.lit("missing_chapter_name")),
            F.when(F.col("metadata.effective_date").isNull(), F.lit("missing_date")),
            F.when(F.col("metadata.effective_date").isNotNull() & ~F.year("metadata.effective_date").between(1800, 2100), F.lit("implausible_date")),
            F.when(F.length("text") < short, F.lit("short_text")),
            F.when(F.size("metadata.history") <= 0, F.lit("missing_history")),
            F.when(F.col("dup"), F.lit("duplicate_id")),
            F.when(F.col("text").contains("�"), F.lit("replacement_character")),
        )
    )
    return raw.withColumn("dup", dup).select(F.explode(issues).alias("issue"), F.col("metadata.chapter").alias("chapter")).groupBy("issue", "chapter").agg(F.count("*").alias("n"))


def chapter_sections(raw: DataFrame) -> DataFrame:
    """One row a section of each chapter: its place in natural order, and how many there are."""
    rows = raw.select(F.col("metadata.chapter").alias("chapter"), F.col("metadata.section").alias("section")).where("section <> ''").distinct()
    number = F.transform(F.split("section", r"\."), lambda x: x.cast("int"))
    place = F.row_number().over(Window.partitionBy("chapter").orderBy(number, "section"))
    counts = rows.groupBy("chapter").agg(F.count("*").alias("n_sections"))
    return rows.withColumn("position", place).join(counts, "chapter").select("chapter", "n_sections", "position", "section")


def version_in_force(documents: DataFrame, as_of: str) -> DataFrame:
    """As-of view: of each id, the version with the latest effective date not after a day."""
    return (
        documents.where(F.col("effective_date") <= F.lit(as_of).cast("date"))
        .groupBy("id")
        .agg(F.max(F.struct("effective_date", "scraped_at")).alias("v"))
        .select("id", F.col("v.effective_date").alias("effective_date"), F.col("v.scraped_at").alias("scraped_at"))
    )
