"""Text functions as columns: citations, dates, whitespace, HTML and small classifiers.

Everything stays in built-in expressions, so it runs inside whole-stage code generation.  Patterns
avoid look-around and use explicit classes where dialects differ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The citation grammars of the domain.
SUBSECTIONS = r"((?:\([0-9a-z]+\))*(?:\d+\.?[a-z]?)?)"
STATUTE = rf"(?i)(?:§|section|s\.)[\s\x{{a0}}]*(\d{{1,3}}\.\d{{2,4}}){SUBSECTIONS}|(\d{{1,3}}\.\d{{2,4}}){SUBSECTIONS},?[\s\x{{a0}}]*F\.?S\.?"
RULE = r"(?i)R(?:ule)?\.?[\s\x{a0}]*(\d{1,2}[A-Z]?-\d+\.\d+)((?:\([0-9a-z]+\))*)|(\d{1,2}[A-Z]?-\d+\.\d+)((?:\([0-9a-z]+\))*),?[\s\x{a0}]*F\.?A\.?C\.?"
CASE = r"(?i)(\d{1,4})\s+(So\.\s*[23]d|Fla\.\s*L\.\s*Weekly(?:\s*Supp\.)?|Fla\.)\s+(\d{1,5})"
CHAPTER = r"(?i)(?:chapters?|ch\.)\s+(\d{1,3})"
# Marks of each kind of citation, the forms of a section number, and the words around a
# citation that tell how it relates, in the order they are tried.
CASE_MARK, RULE_MARK = r"(?i)v\.\s+\w+|vs\.\s+\w+", r"(?i)(?:Rule\s+|F\.?A\.?C\.?\s*R?\.?\s*)[\dA-Za-z.-]+"
SECTION_FORMS = (r"(?i)(?:Fla\.?\s*Stat\.?\s*)?§\s*([\d.]+(?:\([^)]+\))*)", r"(?i)(?:Rule\s+|F\.?A\.?C\.?\s*R?\.?\s*)([\dA-Za-z.-]+)", r"(\d+\.\d+(?:\([^)]+\))*)")
PREFIXES = (r"^(fla\.?\s*stat\.?\s*)?§?\s*", r"^(rule\s+|f\.?a\.?c\.?\s*r?\.?\s*)")
RELATIONS = (
    ("rule", "rulemaking authority|authority:|specific authority", "authority"),
    ("rule", "law implemented|implements|implementing", "implements"),
    ("case", "interpret|constru|held that|holding|pursuant to", "interprets"),
    (None, "amend", "amends"),
    (None, "supersed|replac|repeal", "supersedes"),
)
LEXIS = r"(?i)(\d{4})\s+(Fla\.?\s*LEXIS|WL)\s+(\d+)"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
# Entities that leftover HTML holds, in the order they are replaced.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&mdash;", "—"), ("&ndash;", "–"), ("&sect;", "§"))
# Words that make a question complex, and county names.
COMPLEX_WORDS = ("and", "or", "both", "also", "as well as", "in addition", "multiple", "various", "different", "compare", "versus", "vs")
COUNTIES = ("miami", "miami-dade", "broward", "palm beach", "hillsborough", "orange", "pinellas", "duval", "lee", "polk")


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _either(c: Column, pattern: str, number) -> Column:
    """Matches of a two-sided grammar, in order: number and subsections of whichever side matched."""
    sides = [_all(c, pattern, g) for g in (1, 2, 3, 4)]
    zipped = F.arrays_zip(*[s.alias(f"g{i}") for i, s in enumerate(sides, 1)])
    return F.transform(
        zipped,
        lambda m: F.concat(
            number(F.when(m["g1"] != "", m["g1"]).otherwise(m["g3"])),
            F.lower(F.when(m["g1"] != "", m["g2"]).otherwise(m["g4"])),
        ),
    )


def statute_citations(c: Column) -> Column:
    """Distinct statute citations in normal form, sorted."""
    return F.array_sort(F.array_distinct(statute_citations_in_order(c)))


def statute_citations_in_order(c: Column) -> Column:
    return _either(c, STATUTE, lambda n: n)


def rule_citations(c: Column) -> Column:
    """Distinct rule citations, rule letter in upper case, sorted."""
    return F.array_sort(F.array_distinct(_either(c, RULE, F.upper)))


def case_citations(c: Column) -> Column:
    parts = F.arrays_zip(*[_all(c, CASE, g).alias(f"g{g}") for g in (1, 2, 3)])
    return F.array_sort(F.array_distinct(F.transform(parts, lambda m: F.concat_ws(" ", m["g1"], m["g2"], m["g3"]))))


def chapter_number(c: Column) -> Column:
    """The number of a text's first chapter mention, else its first number of three digits."""
    named, bare = F.regexp_extract(c, r"(?i)\bChapter\s+(\d+)\b", 1), F.regexp_extract(c, r"\b(\d{3})\b", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(bare, F.lit(""))).cast("int")


def chapter_mentions(c: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(c, CHAPTER, 1)))


def normal_whitespace(c: Column) -> Column:
    """LF line ends, single blanks, trimmed lines, at most two blank lines in a row."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    c = F.regexp_replace(c, r"\n{4,}", "\n\n\n")
    return F.regexp_replace(c, r"^[ \n]+|[ \n]+$", "")


def clean_html(c: Column) -> Column:
    """Entities in their fixed order, tags dropped, whitespace made normal."""
    for entity, sign in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return normal_whitespace(F.regexp_replace(c, r"<[^>]+>", ""))


def iso_date(c: Column) -> Column:
    """The date before ``T``; null where there is none."""
    return F.try_to_date(F.substring_index(c, "T", 1), "yyyy-MM-dd")


def written_dates(c: Column) -> Column:
    """Dates such as March 1, 2024, or 2024-03-01, or 3/1/2024: distinct, sorted, invalid ones dropped."""
    names = "|".join(MONTHS)
    a = F.transform(_all(c, rf"((?:{names}) \d{{1,2}}, \d{{4}})", 1), lambda x: F.try_to_date(x, "MMMM d, yyyy"))
    b = F.transform(_all(c, r"(\d{4}-\d{2}-\d{2})", 1), lambda x: F.try_to_date(x, "yyyy-MM-dd"))
    d = F.transform(_all(c, r"(\d{1,2}/\d{1,2}/\d{4})", 1), lambda x: F.try_to_date(x, "M/d/yyyy"))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(a, b, d))))


def query_year(c: Column, as_of: int) -> Column:
    """The first year 20dd of a question, else the year given."""
    found = F.regexp_extract(c, r"\b(20\d{2})\b", 1)
    return F.when(found != "", found.cast("int")).otherwise(F.lit(as_of))


def needs_splitting(c: Column) -> Column:
    """Eight words or more and a sign of several questions (words count as substrings)."""
    low = F.lower(c)
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    any_of = lambda terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))
    marks = F.length(c) - F.length(F.replace(c, F.lit("?"), F.lit("")))
    return (words >= 8) & (any_of(COMPLEX_WORDS) | (marks > 1) | any_of(COUNTIES))


def normal_citation(c: Column) -> Column:
    """Comparison form of a citation: lower case, prefixes and blanks dropped."""
    c = F.lower(F.trim(c))
    for prefix in PREFIXES:
        c = F.regexp_replace(c, prefix, "")
    return F.regexp_replace(c, r"\s+", "")


def base_citation(c: Column) -> Column:
    """Comparison form without any part in parentheses."""
    return F.regexp_replace(normal_citation(c), r"\([^)]*\)", "")


def citations_match(generated: Column, expected: Column) -> Column:
    """Equal, or more specific than expected, or of the same base (so siblings match)."""
    g, e = normal_citation(generated), normal_citation(expected)
    longer = F.startswith(g, e) & (F.substring(g, F.length(e) + 1, F.lit(1)) == "(")
    return (g == e) | longer | (base_citation(generated) == base_citation(expected))


def normal_case_citation(c: Column) -> Column:
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.lower(F.replace(F.replace(c, F.lit(". "), F.lit(" ")), F.lit("."), F.lit("")))


def citation_kind(c: Column) -> Column:
    """case, taa, statute, rule or unknown, in this order."""
    low = F.lower(c)
    return (
        F.when(c.rlike(CASE_MARK), "case")
        .when(low.contains("taa") | low.contains("technical assistance"), "taa")
        .when(c.contains("§") | low.contains("statute"), "statute")
        .when(c.rlike(RULE_MARK) | low.contains("f.a.c"), "rule")
        .otherwise("unknown")
    )


def section_number(c: Column) -> Column:
    """The section a citation names: statute form, rule form, bare number; null if none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in SECTION_FORMS])


def relation_type(context: Column, doc_type: Column) -> Column:
    """How a citing text relates to what it cites, from the words around the citation."""
    low, out = F.lower(context), F.lit("cites")
    for kind, words, relation in reversed(RELATIONS):
        said = low.rlike(words)
        out = F.when(said if kind is None else said & (doc_type == kind), relation).otherwise(out)
    return out


def encoding_flags(c: Column) -> Column:
    """Replacement characters, NULs and other control characters of a text, as a joined list."""
    return F.concat_ws(
        ",",
        F.when(c.contains("�"), "replacement"),
        F.when(c.rlike(r"\x{00}"), "nul"),
        F.when(c.rlike(r"[\x{01}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]"), "control"),
    )


def contains_share(answer: Column, phrases: Column) -> Column:
    """Share of the phrases that an answer contains, case aside; 1 where none is expected."""
    low = F.lower(answer)
    return F.when(F.coalesce(F.size(phrases), F.lit(0)) <= 0, 1.0).otherwise(
        F.size(F.filter(phrases, lambda p: F.contains(low, F.lower(p)))) / F.size(phrases)
    )


def cited_sources(c: Column) -> Column:
    """What stands in ``[Source: …]``, in order."""
    return F.transform(_all(c, r"\[Source:\s*([^\]]+)\]", 1), lambda x: F.trim(x))


def bracket_safe_word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"[ \t\r\n]+"), lambda w: w != ""))
