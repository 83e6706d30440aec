import pytest
from pyspark.sql import functions as F

from statloom.llm import scans as S

CLEAN = [
    "The Department has consistently held that dental molds furnished by the taxpayer are exempt when a closing agreement is kept on file.",
    "The well-documented, third-party appraisal valued the coin-operated games; a tax-exempt buyer and a so-called membership charge are part of the sales price.",
    "Section 202.60, F.S., imposes tax on the privilege of engaging in business; the auditors confirmed a balance of $42,655 on July 17, 1997.",
    "The first issue is one of sourcing: whether hull coatings are delivered where the seller receives them or where title vests, and whether the presumption has been overcome.",
    "This response is binding only on the facts described. FACTS CONCLUSION LAW AND DISCUSSION. The lease covers satellite receivers and mobile homes in use for business.",
]


#: Page lines as they cut sentences of other texts; the operator has to learn them from there.
LINES = ["Page 1", "[1]", "- 1 -", "1/3", "DEPARTMENT OF REVENUE", "TAA NO. 11A00-01#", "PAGE 1"]
TRACES = [
    ("The Department has con-\nsistently held that dental molds are exempt.", "consistently held"), ("furnished by the tax¬\npayer are exempt", "taxpayer are"), ("closing agree- \nment is kept", "agreement is"),
    ("Page 2\nthe auditors confirmed a balance", "the auditors"), ("the auditors confirmed\n2/4\na balance", "confirmed a balance"), ("[3]\nthe auditors confirmed", "the auditors"), ("the auditors\f- 2 -\nconfirmed", "the auditors"), ("DEPARTMENT OF REVENUE\nTAA NO. 10A00-016\nPAGE 2\nthe auditors", "the auditors"),
    ("thc auditors confirmed a balance on the facts", "the auditors"), ("hu11 coatings are de1ivered", "hull coatings are delivered"), ("the presurnption has been overcorne", "presumption has been overcome"), ("vvhether clental rnolds are exempt", "whether dental molds"), ("satelhte receivers", "satellite receivers"),
    ("the auditors c o n f i r m e d a balance", "confirmed a balance"), ("a balance of $39,2O9 on July 17", "$39,209"),
]
SOUND = [
    *CLEAN, "a tax-\nexempt buyer and a third-\nparty appraisal", "the so-\ncalled membership charge", "These invoices are at issue:\n1909\n1722\n328\nThe first issue", "Page 5 of the lease so provides.\nThe first issue is one of sourcing.", "Rule 12A-\n3.026, F.A.C.",
    "TAA 17I00-004\nRe: Tax on hull coatings\nFACTS\nThe lease", "1. mobile homes\n2. hull coatings\nThe first issue", "The taxpayerâ€™s balance", "",
]


def corpus(misreadings=True):
    rows = [(1000 + i, t + f" Order {i}.") for i, t in enumerate(CLEAN * 40)]
    for k, line in enumerate(LINES):
        body = ["The auditors of the office in that county confirmed in May", "that the lease names a balance for all of the mobile homes", "and that the purchaser paid the whole of the sum on the day"]
        rows += [(5000 + 10 * k + i, "\n".join([f"Order {i} of that year.", *body, line.replace("#", str(i)), *body[1:], "that the lease names."])) for i in range(6)]
    return rows


@pytest.fixture(scope="module")
def repaired(spark):
    rows = corpus() + [(i, t) for i, (t, _) in enumerate(TRACES)] + [(100 + i, t) for i, t in enumerate(SOUND)]
    df = spark.createDataFrame(rows, "raw_id long, text string")
    return {r.raw_id: r for r in S.repair_scans(df, ["raw_id"], only_found=False).collect()}


@pytest.mark.parametrize("i", range(len(TRACES)))
def test_traces_are_repaired(repaired, i):
    assert repaired[i].scanned and TRACES[i][1] in repaired[i].repaired_text


@pytest.mark.parametrize("i", range(len(SOUND)))
def test_no_case(repaired, i):
    r = repaired[100 + i]
    assert not r.scanned and r.repaired_text == SOUND[i]


def test_little_is_misread_without_a_model(spark, repaired):
    """The channel and the counts do the finding: alone, the same texts show next to no misread word."""
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TRACES)], "raw_id long, text string")
    alone = S.repair_scans(df, ["raw_id"], only_found=False).agg(F.sum("n_misread")).first()[0]
    assert alone <= 2 and sum(repaired[i].n_misread for i in range(len(TRACES))) >= 9


@pytest.mark.parametrize("seen, true", [("tbe", "the"), ("custorner", "customer"), ("arid", "and"), ("taxabihty", "taxability"), ("vvas", "was"), ("hu11", "hull"), ("c1ated", "dated"), ("2o#", "2##")])
def test_alignment(seen, true):
    assert S.align(seen, true) and set(S.stroke_keys(seen)) & set(S.stroke_keys(true))


def test_unlike_words_do_not_align():
    assert S.align("tax", "fee") is None and not set(S.stroke_keys("tax")) & set(S.stroke_keys("fee"))


def test_context_decides(spark):
    """A real word that may be a misreading of a far commoner one stays where its neighbours know it."""
    rows = [(i, f"we went east of the river number {i} and east again to the east coast") for i in range(300)]
    rows += [(1000 + i, f"pipes of cast iron in lot {i}") for i in range(8)] + [(2000, "we went cast of the river")]
    got = {r.raw_id: r for r in S.repair_scans(spark.createDataFrame(rows, "raw_id long, text string"), ["raw_id"]).collect()}
    assert got[2000].repaired_text == "we went east of the river" and set(got) == {2000}


def test_reflow():
    lines = ["FACTS", "The auditors confirmed a balance of that sum on", "the day named in the lease for all of the mobile", "homes.", "", "A new paragraph."]
    assert S.reflow(lines) == "FACTS\nThe auditors confirmed a balance of that sum on the day named in the lease for all of the mobile homes.\nA new paragraph."


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_copies_of_a_scan_are_one_witness(spark, monkeypatch, most):
    """A scan that a third of all rows are copies of does not make its misreadings words."""
    monkeypatch.setattr(S, "MOST_COPIED", most)
    scan = "The auditors of tbe office confirmed a balance of tbe sum of hull coatinqs."
    rows = corpus() + [(20_000 + i, scan) for i in range(120)] + [(30_000, scan + " Order 7.")]
    got = {r.raw_id: r for r in S.repair_scans(spark.createDataFrame(rows, "raw_id long, text string"), ["raw_id"]).collect()}
    assert all(20_000 + i in got for i in range(120)) and got[20_005].repaired_text == "The auditors of the office confirmed a balance of the sum of hull coatings."


def test_operator(spark):
    odd = "thc taxpayer con-\nsistently held"
    rows = corpus() + [(90, odd), (91, None), (92, ""), (90, odd), (93, "word " * 40_000), (94, "thc auditors " * 5_000 + "confirmed")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "raw_id long, text string, scanned int, repaired_text string")
    every = {}
    for r in S.repair_scans(df, ["raw_id", "scanned"], only_found=False).collect():
        every.setdefault(r.raw_id, []).append(r)
    assert len(every[90]) == 2 and all(r.repaired_text == "the taxpayer consistently held" for r in every[90])
    assert every[91][0].repaired_text is None and every[92][0].repaired_text == "" and not every[93][0].scanned
    assert sum(map(len, every.values())) == len(rows)
    found = [r.raw_id for r in S.find_scans(df, ["raw_id"]).collect()]
    assert found.count(90) == 2 and 91 not in found
    empty = df.limit(0)
    assert S.repair_scans(empty, ["raw_id"]).count() == 0 and S.find_scans(empty, ["raw_id"]).count() == 0


def test_long_odd_texts_take_linear_time():
    none = lambda w: False
    for text in ("1\n" * 200_000, "5a-\n" * 100_000, "TITLE 1\n" * 100_000 + "and a body line that is long enough to be one of the text\n" * 3, "a b c d " * 50_000, "x\f" * 100_000, "-" * 300_000, "a¬\n" * 50_000):
        S.text_events(text, none)
        S.lone_lines(text)
