import pytest
from pyspark.sql import functions as F

from statloom.functions import acquire as Q
from statloom.functions import text as T
from statloom.operators import citations


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize("text, want", [
    ("See § 212.05", ["212.05"]), ("§212.05", ["212.05"]), ("Section 212.05", ["212.05"]), ("s. 212.05", ["212.05"]), ("212.05, F.S.", ["212.05"]),
    ("§ 212.05(1)(A)", ["212.05(1)(a)"]), ("§ 212.05 and § 212.06 and § 212.08", ["212.05", "212.06", "212.08"]), ("ss. 212.05, 212.06", ["212.05"]), ("none", []), ("", []),
])
def test_statutes(spark, text, want):
    assert one(spark, T.statute_citations, text) == want


def test_rules_cases_chapters(spark):
    assert one(spark, T.rule_citations, "Rule 12a-1.005(1), 12B-4.013, F.A.C.") == ["12A-1.005(1)", "12B-4.013"]
    assert one(spark, T.case_citations, "Smith v. State, 366 So. 2d 1173") == ["366 So. 2d 1173"]
    assert one(spark, T.chapter_mentions, "chapter 212 and ch. 95") == ["212", "95"]


def test_whitespace_and_html(spark):
    assert one(spark, T.normal_whitespace, "  a \t b \r\n\n\n\n\n c  ") == "a b\n\n\nc"
    assert one(spark, T.clean_html, "<p>A &amp; B&nbsp;&sect; 1</p>") == "A & B § 1"
    assert one(spark, T.clean_html, "<p>A &amp;lt; B</p>") == "A"  # entities first, then what looks like a tag


def test_dates(spark):
    assert [str(x) for x in one(spark, T.written_dates, "March 1, 2024 and 2023-02-30 and 1/2/2020 and 2024-03-01")] == ["2020-01-02", "2024-03-01"]
    assert one(spark, T.iso_date, "2024-05-01T10:00:00Z").isoformat() == "2024-05-01"
    assert one(spark, T.iso_date, "soon") is None


def test_matching(spark):
    m = lambda a, b: one(spark, T.citations_match, a, b)
    assert m("§ 212.05(1)(a)", "212.05") and m("212.05(1)", "212.05(2)") and m("Rule 12A-1.001", "12a-1.001")
    assert not m("212.051", "212.05") and not m("212.08(7)(a)2.", "212.08(7)(a)")


@pytest.mark.parametrize("c, kind", [("Smith v. State", "case"), ("TAA 19A-001", "taa"), ("§ 212.05", "statute"), ("Rule 12A-1.005", "rule"), ("see above", "unknown")])
def test_kinds(spark, c, kind):
    assert one(spark, T.citation_kind, c) == kind


@pytest.mark.parametrize("context, kind, want", [
    ("Rulemaking Authority 212.05", "rule", "authority"), ("Law Implemented 212.05", "rule", "implements"), ("the court held that", "case", "interprets"),
    ("as amended by", "taa", "amends"), ("is repealed", "statute", "supersedes"), ("see", "statute", "cites"), ("held that", "taa", "cites"),
])
def test_relations(spark, context, kind, want):
    assert one(spark, T.relation_type, context, kind) == want


def test_gate(spark):
    gate = lambda q: one(spark, T.needs_splitting, q)
    assert gate("What is the sales tax rate and who must pay it") and not gate("tax and rate") and gate("what rate is due here now? who pays it then?")


def test_spans_and_resolution(spark):
    found = citations.spans("See § 212.05(1) and § 212.05(1); Rule 12a-1.005; 366 So. 2d 1173 (Fla. 1979); chapter 212-220.")
    assert [(k, n) for k, _, n, *_ in found] == [("statute", "212.05(1)"), ("rule", "12A-1.005"), ("case", "366 So. 2d 1173"), ("chapter", "chapter 212-220")]
    chunks = spark.createDataFrame(
        [("chunk:statute:212.05:1", "statute:212.05", "statute", ""), ("chunk:statute:212.05:0", "statute:212.05", "statute", ""), ("chunk:case:1:0", "case:1", "case", "Smith v. State, 366 So. 2d 1173")],
        "id string, doc_id string, doc_type string, citation string",
    )
    cited = spark.createDataFrame([("statute", "212.05(1)", "212.05"), ("statute", "x", "212.05(9)"), ("case", "366 So. 2d 1173", None), ("chapter", "chapter 212", "212"), ("statute", "9.9", "9.9")], "kind string, normalized string, section string")
    got = {(r.normalized, r.target_chunk_id, float(r.confidence)) for r in citations.resolve(cited, citations.document_index(chunks)).collect()}
    assert got == {("212.05(1)", "chunk:statute:212.05:0", 1.0), ("x", "chunk:statute:212.05:0", 0.8), ("366 So. 2d 1173", "chunk:case:1:0", 0.9), ("chapter 212", None, 0.0), ("9.9", None, 0.0)}


def test_acquire(spark):
    assert one(spark, Q.history_years, "History.—s. 1, ch. 26319, 1949; s. 2, ch. 95-290; s. 3, ch. 2024-99; s. 4, ch. 05-1.") == [1949, 1995, 2005, 2024]
    assert one(spark, Q.taa_number, "data/TAA%2025A01-19.pdf") == "TAA 25A01-19" and one(spark, Q.tax_code, "TAA 25b01-19") == "B"
    html = "<a href='/x/0212ContentsIndex.html'>Chapter 212</a><a href='/Sections/0212.05.html'>212.05 — Sales</a><a href='/Sections/0212.1.html'>212.1 X</a><a href='TAA%2019A-001.pdf'>t</a>"
    pages = spark.createDataFrame([("u", html)], "url string, html string")
    assert [r.chapter for r in Q.chapter_links(pages).collect()] == [212]
    assert [(r.section, r.name) for r in Q.section_links(pages).collect()] == [("212.1", "X"), ("212.05", "Sales")]
    assert [r.taa for r in Q.taa_links(pages).collect()] == ["TAA 19A-001"]
    rule = "<title>12A-1.001 : Specific Exemptions - Florida</title><td>Rule Title: Exemptions</td><td>Text here. Effective Date: 1/2/2020</td><td>Rulemaking Authority 212.18(2), 213.06 FS. Law Implemented 212.08 FS. History–New 1.</td><script>x</script>"
    r = spark.createDataFrame([(rule,)], "h string").select(*[c.alias(n) for n, c in Q.rule_page(F.col("h")).items()]).first()
    assert r.title == "Exemptions" and r.rulemaking_authority == ["212.18(2)", "213.06"] and r.law_implemented == ["212.08"] and str(r.effective_date) == "2020-01-02"
    case = one(spark, Q.case_record, '{"absolute_url": "/opinion/77/x/", "caseName": "A v. B", "dateFiled": "2020-01-02", "opinions": [{"cites": ["5", "x", "5"]}]}')
    assert case.cluster_id == 77 and case.cases_cited == [5] and one(spark, Q.case_record, "{}") is None


def test_chapter_numbers_and_advisement_parts(spark):
    from statloom.functions import acquire as Q

    long = "x " * 80
    df = spark.createDataFrame([("see chapter 212 of it",), ("only 215 here",), ("none",), (f"FACTS\n{long}\nRESPONSE\n{long}\nSincerely",), ("QUESTION\nshort\nANSWER\nshort\nThis letter",)], "t string")
    got = df.select(T.chapter_number(F.col("t")).alias("n"), Q.asked(F.col("t")).alias("q"), Q.answered(F.col("t")).alias("a")).collect()
    assert [r.n for r in got][:3] == [212, 215, None] and got[3].q == long.strip() and got[3].a == long.strip() and got[4].q == "" and got[4].a == ""
    assert spark.range(1).select(Q.clean_title(F.lit(" Sales tax.— "))).first()[0] == "Sales tax"


def test_stage_events(spark):
    from statloom.streaming import streams

    df = spark.createDataFrame([(1, ["retrieve", "answer"], "a" * 900), (2, None, None)], "request_id int, stages array<string>, answer string")
    rows = streams.stage_events(df, text="answer").orderBy("request_id", "seq").collect()
    assert [(r.request_id, r.event) for r in rows] == [(1, "retrieve"), (1, "answer"), (1, "complete"), (2, "complete")] and len(rows[2].data) == 500
