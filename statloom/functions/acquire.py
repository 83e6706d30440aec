"""Parsing of acquired pages and advisement texts, as columns over (url, html) or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.text import MONTHS, normal_whitespace

# Names of the tax types by their letter in an advisement's number.
TAX_TYPES = {
    "A": "Sales and Use Tax", "B": "Corporate Income Tax", "C": "Documentary Stamp Tax", "D": "Property Tax", "E": "Estate Tax", "F": "Fuel Tax", "G": "Gross Receipts Tax",
    "H": "Hazardous Waste Tax", "I": "Insurance Premium Tax", "L": "Local Option Tax", "M": "Motor Vehicle Tax", "N": "Communications Services Tax", "P": "Pollutant Tax",
    "R": "Reemployment Tax", "S": "Solid Waste Tax", "T": "Tobacco Tax", "U": "Unemployment Tax", "V": "Severance Tax", "W": "Withholding Tax",
}
# Topics looked for in a subject line.
TOPICS = (
    "exemption", "exempt", "taxable", "sale", "purchase", "resale", "service", "lease", "rental", "repair", "installation", "manufacturing", "agriculture", "construction", "real property",
    "tangible personal property", "software", "digital", "electronic", "food", "medical", "educational", "nonprofit", "government", "import", "export", "interstate", "intrastate",
)
# Navigation words whose lines are dropped from a rule's text.
NAVIGATION = ("Previous", "Up", "Next", "MyFLRules", "Add to Favorites")
# Notations of years in a history note, of an issue date, and of a rule page's parts.
LONG_YEARS, SHORT_YEAR = (r"ch\.\s*\d+,\s*(\d{4})", r"ch\.\s*(\d{4})-\d+", r",\s*(\d{4})\."), r"ch\.\s*(\d{2})-\d+"
_DAY = rf"(?:{'|'.join(MONTHS)})\s+\d{{1,2}},?\s+\d{{4}}"
ISSUED, WRITTEN_DAY, SLASHED_DAY = rf"(?i)(?:Date|Dated|Issued)[:\s]+({_DAY})", rf"(?i)({_DAY})", r"(\d{1,2}/\d{1,2}/\d{4})"
RULE_PARTS = {
    "title": r"Rule Title:\s*([^\n]+)", "page_title": r"(?is)<title>[^:<]*:\s*([^<-]+?)\s*(?:-[^<]*)?</title>", "effective": r"(?i)Effective Date:?\s*(\d{1,2}/\d{1,2}/\d{4})",
    "authority": r"(?is)Rulemaking Authority\s+(.*?)\s+Law Implemented", "law": r"(?is)Law Implemented\s+(.*?)\s+History", "history": r"(?s)History[–-]\s*(.*?)(?:\s*$|\s*Previous|\s*Up|\s*Next)",
    "linked": r"statute\.asp\?id=([^&\"']+)", "cited": r"\b(\d{3}\.\d+(?:\([^)]+\))*(?:\d+\.)?)",
}
# Headers around the question and the answer of an advisement, and their size limits.
QUESTION_FORMS = (r"(?i)(?:QUESTION|ISSUE|FACTS)[:\s]*\n([\s\S]+?)(?=\n(?:ANSWER|RESPONSE|CONCLUSION|RULING))", r"(?i)(?:Your (?:question|inquiry|request))[:\s]*([\s\S]+?)(?=\n(?:ANSWER|RESPONSE|CONCLUSION|Based on))")
ANSWER_FORMS = (r"(?i)(?:ANSWER|RESPONSE|CONCLUSION|RULING)[:\s]*\n([\s\S]+?)(?=\n(?:TAXPAYER|DEPARTMENT|Sincerely|This (?:letter|TAA)))", r"(?i)(?:Based on the (?:facts|information))[:\s]*([\s\S]+?)(?=\n(?:TAXPAYER|Sincerely|This (?:letter|TAA)))")
# What files of other series on the same index page have in their address or label.
OTHER_FOLDER, OTHER_SERIES = "/tips/", "pto bul"
LEAST_SECTION, MOST_QUESTION, MOST_ANSWER = 100, 5000, 10000
ROMAN = ((10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def _group(c: Column, pattern: str, g: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, g), F.lit(""))


def history_years(c: Column) -> Column:
    """Amendment years of a history note: four notations, two-digit years up to 29 are 20xx, only
    1800 to 2100, distinct and sorted."""
    every = lambda p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    short = F.transform(every(SHORT_YEAR), lambda y: F.when(y.cast("int") <= 29, F.lit(2000)).otherwise(1900) + y.cast("int"))
    long = F.transform(F.concat(*map(every, LONG_YEARS)), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(long, short), lambda y: y.between(1800, 2100))))


def body_and_history(c: Column) -> tuple[Column, Column]:
    """A statute's text before its history note, and the note."""
    at = F.locate("History.", c)
    body = F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)
    return F.regexp_replace(body, r"\s+$", ""), F.when(at > 0, F.substring(c, at, F.length(c))).otherwise("")


def taa_number(filename: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"(?i)\.pdf$", "")
    name = F.trim(F.regexp_replace(F.replace(name, F.lit("%20"), F.lit(" ")), r"(?i)^TAA", ""))
    return F.concat(F.lit("TAA "), name)


def tax_code(number: Column) -> Column:
    return F.upper(F.regexp_extract(number, r"(?i)TAA\s*\d{2}([A-Z])", 1))


def tax_name(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TAX_TYPES.items() for x in kv])
    return F.when(code == "", "Unknown").otherwise(F.coalesce(F.try_element_at(table, code), F.concat(F.lit("Unknown ("), code, F.lit(")"))))


def subject(c: Column) -> Column:
    """The subject line, longer than ten characters, without a trailing advisement number; else ''."""
    raw = F.coalesce(_group(F.substring(c, 1, 3000), r"(?:Re|RE|Subject)[:\s]+([^\n]+)"), _group(F.substring(c, 1, 3000), r"(?:SUBJECT|MATTER)[:\s]+([^\n]+)"), F.lit(""))
    clean = F.regexp_replace(F.trim(raw), r"\s*[-–]\s*TAA.*$", "")
    return F.when(F.length(clean) > 10, clean).otherwise("")


def _first_section(c: Column, forms: tuple[str, ...], most: int) -> Column:
    tries = [F.regexp_replace(_group(c, p), r"^\s+|\s+$", "") for p in forms]
    return F.coalesce(*[F.when(F.length(t) > LEAST_SECTION, F.substring(t, 1, most)) for t in tries], F.lit(""))


def asked(c: Column) -> Column:
    """The question of an advisement: the first form that gives more than 100 characters, cut; else ''."""
    return _first_section(c, QUESTION_FORMS, MOST_QUESTION)


def answered(c: Column) -> Column:
    """The answer of an advisement, likewise."""
    return _first_section(c, ANSWER_FORMS, MOST_ANSWER)


def clean_title(c: Column) -> Column:
    """A section's title without the dashes and points it ends in."""
    return F.trim(F.regexp_replace(F.trim(c), r"[.\-—]+$", ""))


def topics(subject_line: Column) -> Column:
    low = F.lower(subject_line)
    found = F.filter(F.array(*[F.lit(t) for t in TOPICS]), lambda t: F.contains(low, t))
    return F.slice(F.transform(found, F.initcap), 1, 5)


def issue_date(c: Column) -> Column:
    head = F.substring(c, 1, 2000)
    named, anywhere, slashed = (_group(head, p) for p in (ISSUED, WRITTEN_DAY, SLASHED_DAY))
    return F.coalesce(F.try_to_date(F.regexp_replace(F.replace(F.coalesce(named, anywhere), F.lit(","), F.lit("")), r"\s+", " "), "MMMM d yyyy"), F.try_to_date(slashed, "M/d/yyyy"))


def roman(n: Column) -> Column:
    out, rest = F.lit(""), n
    for value, sign in ROMAN:
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = F.pmod(rest, F.lit(value))
    return out


def chapter_path(chapter: Column) -> Column:
    """``0200-0299/0212`` for chapter 212."""
    low = F.floor(chapter / 100) * 100
    return F.concat(F.lpad(low.cast("string"), 4, "0"), F.lit("-"), F.lpad((low + 99).cast("string"), 4, "0"), F.lit("/"), F.lpad(chapter.cast("string"), 4, "0"))


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(columns of pages, position, href, label) of every anchor with a target."""
    pattern = r"(?is)<a\s[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("label"))
    out = pages.select("*", F.posexplode(pairs).alias("position", "__a"))
    return out.select(*pages.columns, "position", F.col("__a.href").alias("href"), F.trim(F.regexp_replace("__a.label", r"<[^>]+>", "")).alias("label"))


def chapter_links(pages: DataFrame) -> DataFrame:
    """Links of a title's index to its chapters; the number from the address, else from the label."""
    a = links(pages).where(F.col("href").contains("ContentsIndex.html"))
    n = F.coalesce(_group(F.col("href"), r"/(\d{4})ContentsIndex\.html"), _group(F.col("label"), r"Chapter\s+(\d+)")).cast("int")
    return a.select(n.alias("chapter"), "label", "href").where("chapter is not null").distinct().orderBy("chapter")


def section_links(pages: DataFrame) -> DataFrame:
    """Links of a chapter to its sections in natural order of the numbers."""
    a = links(pages).where(F.col("href").contains("/Sections/") & F.col("href").contains(".html"))
    section = F.coalesce(_group(F.col("label"), r"^(\d+\.\d+)"), F.regexp_replace(_group(F.col("href"), r"/(\d+\.\d+)\.html"), r"^0+", ""))
    name = F.regexp_replace(F.regexp_replace("label", r"^\d+\.\d+", ""), r"^[\s\-—]+", "")
    out = a.select(section.alias("section"), name.alias("name"), "href").where("section is not null").dropDuplicates(["section"])
    return out.orderBy(F.transform(F.split("section", r"\."), lambda x: x.cast("int")))


def taa_links(pages: DataFrame) -> DataFrame:
    """Links to advisement files: PDF suffix, not of another series, a file name of the known form,
    first position wins."""
    a = links(pages).where(F.lower("href").endswith(".pdf") & ~F.lower("href").contains(OTHER_FOLDER))
    a = a.where(~F.lower("label").contains(OTHER_SERIES) & ~F.lower(F.replace("href", F.lit("%20"), F.lit(" "))).contains(OTHER_SERIES))
    a = a.withColumn("taa", taa_number(F.col("href"))).where(F.col("taa").rlike(r"(?i)^TAA \d{2}[A-Z]\d*-\d+"))
    return a.groupBy("taa").agg(F.min_by("href", "position").alias("href"))


def rule_page(html: Column) -> dict[str, Column]:
    """Fields of a rule's page: title, text, date, authority, law implemented, history."""
    no_script = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer)\b.*?</\1>", "")
    text = F.regexp_replace(F.regexp_replace(no_script, r"(?i)<br\s*/?>|</(?:td|tr|p|div|h\d)>", "\n"), r"<[^>]+>", "")
    cited = lambda c: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(RULE_PARTS["cited"]), F.lit(1)), lambda x: F.regexp_replace(x, r"[.,]+$", ""))))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("|".join(NAVIGATION)))
    linked = F.transform(F.regexp_extract_all(html, F.lit(RULE_PARTS["linked"]), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r" ?FS\.", "")))
    return {
        "title": F.coalesce(_group(text, RULE_PARTS["title"]), F.trim(_group(html, RULE_PARTS["page_title"])), F.lit("")),
        "text": F.array_join(lines, "\n"),
        "effective_date": F.try_to_date(_group(text, RULE_PARTS["effective"]), "M/d/yyyy"),
        "rulemaking_authority": F.array_union(cited(_group(text, RULE_PARTS["authority"])), linked),
        "law_implemented": F.array_union(cited(_group(text, RULE_PARTS["law"])), linked),
        "history": F.coalesce(F.trim(_group(text, RULE_PARTS["history"])), F.lit("")),
    }


def statute_page(html: Column) -> dict[str, Column]:
    """Fields of a statute's page: clean text, its history note, the years and the latest date in it."""
    from statloom.functions.text import written_dates

    text = normal_whitespace(F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>|</(?:p|div|tr|h\d)>", "\n"), r"<[^>]+>", ""))
    body, history = body_and_history(text)
    return {"text": body, "history": history, "history_years": history_years(history), "effective_date": F.try_element_at(written_dates(history), F.lit(-1))}


#: Wide schema of a case record as an API delivers it; alternative keys are coalesced.
CASE_SCHEMA = "cluster_id string, id string, absolute_url string, caseName string, case_name string, caseNameFull string, court string, court_id string, dateFiled string, date_filed string, docketNumber string, citation array<string>, snippet string, opinions array<struct<id:string,snippet:string,cites:array<string>>>"


def case_record(json: Column) -> Column:
    """Struct of a case from an API record; null where no id can be found."""
    r = F.from_json(json, CASE_SCHEMA)
    first = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c])
    number = first(r["cluster_id"], r["id"], _group(r["absolute_url"], r"/opinion/(\d+)/"))
    cites = F.array_distinct(F.transform(F.filter(F.coalesce(F.try_element_at(r["opinions"], F.lit(1))["cites"], F.array().cast("array<string>")), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int")))
    return F.when(
        number.rlike("^[0-9]+$"),
        F.struct(
            number.cast("int").alias("cluster_id"), first(r["caseName"], r["case_name"]).alias("case_name"), first(r["caseNameFull"], r["caseName"], r["case_name"]).alias("case_name_full"),
            first(r["court"], r["court_id"]).alias("court"), F.try_to_date(F.substring(first(r["dateFiled"], r["date_filed"]), 1, 10)).alias("date_filed"), r["docketNumber"].alias("docket_number"),
            F.coalesce(r["citation"], F.array().cast("array<string>")).alias("citations"), cites.alias("cases_cited"), first(r["snippet"], F.try_element_at(r["opinions"], F.lit(1))["snippet"]).alias("snippet"),
        ),
    )
