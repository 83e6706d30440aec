import pytest

from statloom.llm.residue import find_residue, residue

FOUND = [
    "Dear {{ owner.name }}, the tax is due.", "Prepared for ${taxpayer}, on #{date}.", "The rate is <%= rate %> percent.", "Pay {% if officer %} now.", "In [[county]] and <<COUNTY>> the tax",
    "To: [INSERT NAME OF AUDIT],", "[Insert rate here] applies", "on [status of refund - to be completed].", "the [COUNTY NAME TO BE ADDED] levy", "as (insert hearing date) says", "by <insert period> at",
    "%TAXPAYER% owes", "the %(amount)s due", "##NOTICE## is", "__RETURNDATE__ is", "~OWNER~ owes", "*|AMOUNT|* due", "$$TOTAL$$ due", "@@hearing@@ at", "«CountyName» levies", "&lt;OFFICERNAME&gt; shall",
    "Taxpayer, undefined, consumes in this state hull coatings.", "to [object Object] the tax", "{hearing|default:''} is", "from {0} until",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "asdf qwerty foo bar blah test asdf foo", "sample sample sample sample sample sample sample", "The quick brown fox jumps over the lazy dog.", "Texto de ejemplo. Sustituya este párrafo antes de publicar.",
    "(404) The page could not be found.", "HTTP 404 - Uh-oh: the section cannot be displayed.", "Error 429: Sorry, the section is temporarily unavailable.", "504 Gateway Time-out\nThe upstream server did not respond in time.", "Access Denied",
    "This opinion could not be found.", "Traceback (most recent call last):\n  File \"x\"\nKeyError: 'section'", "Página não encontrada. Verifique o endereço e tente novamente.", "Page introuvable. Le document demandé n’existe plus.", "Your session has expired. Please log in again to continue.",
    "You need to enable JavaScript to run this app.", "THE RULE FINDER NEEDS JAVASCRIPT.", "Our site works only with JS.", "Veuillez activer JavaScript pour afficher cette page.", "Loading… If nothing appears, allow scripts and cookies for this page.", "JavaScript is disabled in your browser.",
    "A dealer who fails to file a\n\nMenu  Sign in  Español\nThis page cannot run without scripts. Allow it for this site, then refresh.",
]
SOUND = [
    "", None, "The letter template uses the marker {{county}}, which the clerk replaces before mailing the notice.", "In the return schema, the element <FilerId> holds the registration number and <PeriodEnd> the month.",
    "[T]he burden rests on the party [emphasis added]. [sic] Each [d]ealer keeps its own books [footnote omitted].", "A claim under $500 or 5% of tax [see 212.72] needs no certificate.", "The form asks the dealer to insert the county name in line 93.",
    "Printers call such text lorem ipsum; dummy pages supplied for proofing are taxed as solar panels.", "Customers who opened the seller’s portal saw the message “404 Not Found,” and Marlow LLC credited them $5.",
    "The witness read the screen aloud: “Access denied. Your session has expired.”", "An internal server error on the filing site on September 3, 2002 is reasonable cause to waive the penalty.",
    "The portal went down for maintenance on January 13, 2025; returns filed the next day are timely.", "Web hosting, including the error pages a host serves when a site is unavailable, is a nontaxable service.",
    "If JavaScript is turned off, the e-file site still accepts a quarterly return by upload, and the deadline does not change.", "The vendor’s contract covers custom JavaScript that Brindle Cooperative must enable for each dealer; that programming is not taxable.",
    "Reserved.", "Repealed by s. 3, ch. 98-140.", "Section 201.78 was repealed by s. 32, ch. 98-62; no placeholder language remains.", "Menu  Sign in  Español\nThe tax is levied at 5 percent.", "ООО «Вектор» also does business here.", "Rule 12D-8.041 cannot enlarge the statute it implements.",
    "```\nhello {{name}}\n```\nis example code.",
]


@pytest.mark.parametrize("text", FOUND)
def test_found(text):
    assert residue(text)


@pytest.mark.parametrize("text", SOUND)
def test_sound(text):
    assert residue(text) == []


def test_long_text_is_read_whole():
    body = "The tax is levied at the rate of 5 percent of the sales price. " * 5000
    assert not residue(body) and residue(body + "Notice to {{owner}}.")[0][1] > len(body)


def test_operator_keeps_or_drops(spark):
    df = spark.createDataFrame([(1, "ok text", "k", 1), (2, "Access Denied", "k", 1), (3, None, None, 1), (2, "Access Denied", "k", 1)], "doc_id long, text string, residue string, extra int")
    assert [r.doc_id for r in find_residue(df, ["doc_id"]).collect()] == [2, 2]
    clean = find_residue(df, [], clean=True)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [1, 3]
    assert find_residue(df.limit(0), ["doc_id"]).count() == 0 and find_residue(df, ["doc_id", "residue"]).columns == ["doc_id", "residue", "example"]
