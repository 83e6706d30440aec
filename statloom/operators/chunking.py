"""Parent and child chunks of documents, by kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headers of an advisement and the size limits, in the unit of the counter.
TAA_HEADERS = ("REQUESTED ADVISEMENT", "FACTS", "TAXPAYER'S POSITION", "LAW AND DISCUSSION", "CONCLUSION")
TAA_LEAST, CASE_LEAST, CASE_TARGET = 2000, 600, 500

Counter = Callable[[Column], Column]


def words(c: Column) -> Column:
    """Default counter: words and punctuation marks (a tokenizer's counter can be passed instead)."""
    return F.regexp_count(c, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def subsections(text: Column) -> Column:
    """array<struct<marker, content>>: text after each ``(n)`` that stands alone on its line, to the
    next such marker.  Of two markers that share a line break only the first counts; what stands
    before the first marker and empty contents are dropped."""
    pattern = r"\n\((\d+)\)\n"
    markers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    whole = F.split(text, pattern)
    parts = F.slice(whole, F.lit(2), F.greatest(F.size(whole) - 1, F.lit(0)))
    pairs = F.zip_with(markers, parts, lambda m, p: F.struct(F.concat(F.lit("("), m, F.lit(")")).alias("marker"), _strip(p).alias("content")))
    return F.filter(pairs, lambda x: x["content"] != "")


def taa_sections(text: Column) -> Column:
    """array<struct<at, marker, content>> of the first line of each header, in text order; fewer than
    two headers give none."""
    found = F.filter(
        F.array(*[F.struct(F.regexp_instr(text, F.lit(rf"(?i)\n{h}\n")).alias("at"), F.lit(h).alias("marker")) for h in TAA_HEADERS]),
        lambda x: x["at"] > 0,
    )
    ordered = F.array_sort(found)

    def body(x: Column, i: Column) -> Column:
        start = x["at"] + F.length(x["marker"]) + 2
        end = F.when(i + 1 < F.size(ordered), F.try_element_at(ordered, i + 2)["at"]).otherwise(F.length(text) + 1)
        return F.struct(x["at"].alias("at"), x["marker"].alias("marker"), _strip(F.substring(text, start, F.greatest(end - start, F.lit(0)))).alias("content"))

    return F.when(F.size(ordered) >= 2, F.filter(F.transform(ordered, body), lambda x: x["content"] != ""))


def packed_paragraphs(text: Column, target: int = CASE_TARGET, count: Counter = words) -> Column:
    """array<string>: paragraphs packed greedily; a part is closed when the next paragraph would
    take it over the target."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), _strip), lambda p: p != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).cast("int").alias("n"))

    def step(acc: Column, p: Column) -> Column:
        n = count(p).cast("int")
        close = (acc["n"] + n > target) & (acc["cur"] != "")
        return F.struct(
            F.when(close, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(close | (acc["cur"] == ""), p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p)).alias("cur"),
            F.when(close, n).otherwise(acc["n"] + n).cast("int").alias("n"),
        )

    return F.when(
        F.size(paragraphs) > 1,
        F.aggregate(paragraphs, zero, step, lambda a: F.when(a["cur"] != "", F.array_append(a["done"], a["cur"])).otherwise(a["done"])),
    )


def chunk_documents(documents: DataFrame, count: Counter = words) -> DataFrame:
    """Parents (index 0, the whole text) and children of all documents in one projection: the router
    picks the splitter by kind, other kinds give the parent only.

    ``documents`` has id, doc_type, text, ancestry, citation and effective_date.  A parent lists its
    children's ids; ``text_with_ancestry`` is the ancestry, a blank line and the text, and the count of
    tokens is of that."""
    text = F.col("text")
    none = F.array().cast("array<struct<marker:string,content:string>>")
    plain = lambda a: F.transform(a, lambda x: F.struct(x["marker"].alias("marker"), x["content"].alias("content")))
    case_parts = F.transform(packed_paragraphs(text, count=count), lambda p, i: F.struct(F.concat(F.lit("part-"), (i + 1).cast("string")).alias("marker"), p.alias("content")))
    children = (
        F.when(F.col("doc_type").isin("statute", "rule"), subsections(text))
        .when((F.col("doc_type") == "taa") & (count(text) >= TAA_LEAST), plain(taa_sections(text)))
        .when((F.col("doc_type") == "case") & (count(text) >= CASE_LEAST), case_parts)
    )
    carried = ["ancestry", "citation", "effective_date"]
    with_parts = documents.select("id", "doc_type", *carried, F.coalesce(children, none).alias("children"), "text")
    doc = F.concat(F.lit("chunk:"), F.col("id"), F.lit(":"))
    ids = F.transform("children", lambda x, i: F.concat(doc, (i + 1).cast("string")))
    no_ids = F.array().cast("array<string>")
    rows = F.concat(
        F.array(F.struct(F.lit(0).alias("index"), F.lit("parent").alias("level"), F.lit("").alias("subsection_path"), text.alias("chunk_text"), ids.alias("child_chunk_ids"))),
        F.transform(
            "children",
            lambda x, i: F.struct((i + 1).alias("index"), F.lit("child").alias("level"), x["marker"].alias("subsection_path"), x["content"].alias("chunk_text"), no_ids.alias("child_chunk_ids")),
        ),
    )
    whole = F.concat(F.coalesce("ancestry", F.lit("")), F.lit("\n\n"), F.coalesce("chunk_text", F.lit("")))
    return with_parts.select(F.col("id").alias("doc_id"), "doc_type", *carried, doc.alias("__doc"), F.inline(rows)).select(
        F.concat("__doc", F.col("index").cast("string")).alias("id"),
        "doc_id",
        "doc_type",
        "level",
        "ancestry",
        "subsection_path",
        F.col("chunk_text").alias("text"),
        whole.alias("text_with_ancestry"),
        F.when(F.col("level") == "child", F.concat("__doc", F.lit("0"))).alias("parent_chunk_id"),
        "child_chunk_ids",
        "citation",
        "effective_date",
        count(whole).cast("int").alias("token_count"),
    )
