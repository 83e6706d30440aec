"""Template residue and error-page text.

Three detectors over whole texts, each with the context that tells use from mention:

* unfilled placeholders: one grammar per kind of delimiter.  Every marker is judged by its own
  sentence: one that talks about markers explains ``EXPLAINED`` of them for each word it has for
  them.  Markers in code blocks count as explained.  Then density decides: where the markers left
  over are less than ``LEAST_USED`` of all markers of the text, it is a tutorial, not a template;
* filler: runs of dummy words, keyboard noise, repeated words, and stock sentences in four languages;
* error pages and scripts-required notices: message grammars (status code, apology, subject,
  failure).  A message stands in place of content where it makes up most of its sentence, or begins
  it (or follows a label or menu) and is not a small part of it; within quotation marks, or inside a
  longer sentence, it is reported.

Patterns are searched over the whole text, in the texts that hold one of the strings without which
they cannot match (taken from the patterns themselves).

Defined edge cases: null and empty texts hold no residue; texts of any length are read whole, in
time linear in their length; repeated rows give repeated results; other columns are kept as they are.
"""

from __future__ import annotations

import re
import re._parser as sre
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_NAME = r"[A-Za-z]\w*(?:[ .\-]\w+){0,5}"
_WORDS = r"[A-Za-zÀ-ÿ][^\[\]()<>{}\n]{0,60}?"
#: A slot's description between brackets that say it is to be filled.
_FILL = (
    rf"(?:(?:insert|enter|add|fill in|type|specify|inserte|insira|insérer|ins[ée]rez|your|su|seu|votre)\b[ _-]+{_WORDS}(?: here)?"
    rf"|{_WORDS}\s*(?:-|–|—|:)?\s*(?:to be (?:completed|added|determined|inserted|filled(?: in)?|supplied|confirmed|provided)|goes here|por completar|a completar|à compléter)|tbd|tbc)"
)

#: Words and marks after which a bare ``undefined`` or ``null`` stands for a value.
_BEFORE_VALUE = ", : ; § of to by on at in is and as or for the who due del los les des par por concerned under with from over after until before below above against than".split()

#: Grammars of markers by delimiter; the first character of each is in ``_OPENERS``.
MARKERS = {
    "mustache": rf"\{{\{{\{{?[#/^&>]?\s*{_NAME}(?:\|[^{{}}\n]{{0,30}})?\s*\}}\}}\}}?",
    "statement": r"\{%-?\s*(?:if|for|block|include|set|else|elif|endif|endfor|extends|load|trans|macro|with|url|unless|case|assign)\b[^%\n]{0,60}%\}",
    "braced": rf"[$#!@]\{{\s*{_NAME}\s*\}}",
    "filtered": rf"\{{{_NAME}\|[a-z_]+(?::[^{{}}\n]{{0,20}})?\}}",
    "numbered": r"(?<![\w$#!@{\\])\{(?:\d{1,2}|[a-z]\w*_\w+|[a-z]+[A-Z]\w*)\}(?!\})",
    "server": rf"<[%?](?:=|php|-)?\s*(?:echo\s+)?\$?{_NAME}\s*;?\s*[%?]>",
    "double_square": rf"\[\[\[?\s*{_NAME}\s*\]\]\]?",
    "chevron": rf"<<\s*{_NAME}\s*>>",
    "guillemet": r"«[A-Z][a-z]+(?:[A-Z][a-z]+){1,4}»|«(?:[A-Z]+_[A-Z_]+|[A-Z]?[a-z]+_[a-z_]+)»",
    "guillemet_word": r"«[A-Z][a-z]+»",
    "percent": r"(?<![\w%])%%?[A-Z][A-Z0-9]*(?:[_.\-][A-Z0-9]+)*%%?(?![\w%])",
    "hash": r"(?<![\w#])##[A-Za-z][A-Za-z0-9]*(?:[_ .\-][A-Za-z0-9]+)*##(?![\w#])",
    "underline": r"(?<!\w)__[A-Z][A-Z0-9]*(?:[_.\-][A-Z0-9]+)*__(?!\w)",
    "tilde": r"(?<![\w~])~[A-Z][A-Z0-9]*(?:[_.\-][A-Z0-9]+)*~(?![\w~])",
    "merge": r"\*\|[A-Z][A-Z0-9_:.\-]*\|\*",
    "dollars": r"\$\$[A-Z][A-Z0-9_.\-]*\$\$",
    "ats": r"@@[A-Za-z][\w.\-]*@@",
    "format": r"%\([A-Za-z][\w.\-]*\)[sdrf]",
    "square": rf"\[\s*(?i:{_FILL})\s*\]",
    "round": r"\(\s*(?i:(?:insert|enter|inserte|insira|ins[ée]rer)\s+[A-Za-zÀ-ÿ][^()\n]{0,60}?)\s*\)",
    "angle": rf"<\s*(?i:{_FILL})\s*>",
    "angle_name": r"(?:<|&lt;)(?:[A-Z][A-Z0-9]{2,}(?:[_ ][A-Z0-9]+)*|[A-Z]{2,}_[A-Z_]+)(?:>|&gt;)",
    "square_name": r"\[(?!(?:SIC|RESERVED|SEAL|REPEALED|REDACTED|EMPHASIS|FOOTNOTE|CITATIONS?|INTERNAL|OMITTED|SEE|DELETED|VACANT|EXPIRED|TRANSFERRED|SIGNED|ILLEGIBLE|STAMP)\b)[A-Z]{3,}(?:[ _-][A-Z]{2,}){0,4}\]",
    "object": r"\[object Object\]",
    "value": r"(?:" + "|".join(f"(?<={re.escape(w)} )" for w in _BEFORE_VALUE) + r")(?:undefined|NaN|null)(?=[\s,.;:)]|$)|(?:\A|(?<=\n))(?:undefined|NaN|null)(?=\.?\s*(?:\n|\Z)|[ ,.])",
}
_OPENERS = re.compile(
    r"\{|\[(?=[\[ A-Za-zÀ-ÿ][^\]\[]{2})|<(?=[<%?A-Za-zÀ-ÿ ])|%(?=[%(A-Z])|#[#{]|__(?=[A-Z])|~(?=[A-Z])|\*\||\$[${]|@[@{]|«(?=[A-Za-z])|!\{|&lt;(?=[A-Z])"
    r"|\((?=[ ]*[IiEe]n(?:s|t)[eé])"
)
_VALUES = ("undefined", "NaN", "null")
_VALUE = re.compile(MARKERS.pop("value"))
_MARKER = re.compile("|".join(f"(?P<{k}>{v})" for k, v in MARKERS.items()))

#: Words of a sentence that is about markers rather than made with them.
_ABOUT = re.compile(
    r"\b(?:template|placeholder|marker|merge (?:field|tag|code)|tag|schema|element|attribute|syntax|variable|field code|token|literal|the string|written as|"
    r"replac(?:es?|ed|ing) (?:it|them|the|each|before)|is replaced|are replaced|stands? for|denotes?|example of|tutorial|documentation|plantilla|modelo|gabarit|balise|marcador|etiqueta)\b|,? which (?:the|a) \w+ (?:replaces|fills)",
    re.I,
)
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]+`|<(code|pre)\b[^>]*>.*?</\1>", re.S | re.I)
#: Markers that a word for them explains in its sentence, the least share of a text's markers that are
#: left unexplained in a template, and the least share of its sentence that a message makes up where
#: it is inside it and where it begins it.
EXPLAINED, LEAST_USED, MOST_OF, PART_OF = 1, 0.25, 0.5, 0.2

_LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_NOISE = frozenset("foo bar baz qux asdf asdfg qwerty qwertz xyz xxx blah test testing tester zxcv hjkl jkl lkj abc sample dummy text copy filler content".split())
_WORD = re.compile(r"[^\W\d_]+")

#: Stock filler sentences.
_FILLER = re.compile(
    r"the quick brown fox jumps|texto de (?:ejemplo|exemplo|relleno|prueba|teste)\b|texto provis[oó]ri?o|textes? (?:provisoire|de remplissage|d[’']exemple|factice)|"
    r"sustituya este (?:p[aá]rrafo|texto)|substitu[aí]r? (?:depois|este texto)|(?:dummy|filler|sample|placeholder) (?:text|copy|content|paragraph)\b(?= (?:goes here|here\b|to be|for (?:layout|position)))|"
    r"(?:your|body|main|some) (?:text|content|copy) (?:goes )?here|(?:text|content|section|body|page) (?:goes here|to be (?:added|written|supplied|provided) (?:later|here|by))|"
    r"(?:^|[\n.] ?)\s*(?:TBD|TBA|TODO|FIXME)[.:]|to be written by\b|page (?:is )?under construction|under construction\. check back|(?:content|details|more|text) coming soon|coming soon\b[.!]|"
    r"(?:^|\n)\s*check back (?:later|soon)|p[aá]gina en construcci[oó]n|p[aá]gina em constru[cç][aã]o|page en construction|en cours de r[eé]daction|replace (?:this (?:text|paragraph|sentence)|before publishing)|(?:sample|dummy|placeholder|filler) (?:content|text|copy|paragraph)[.!](?=\s|$)|"
    r"this is (?:a |some )?(?:dummy|filler|sample|placeholder|test) (?:text|paragraph|page|content|document)\b|hello,? world|(?:paragraph|section) \d+ text (?:paragraph|section) \d+ text|"
    r"aqu[ií] va (?:el|su|o) (?:contenido|texto)|aqui vai o (?:conte[uú]do|texto)|ici (?:le|votre) (?:contenu|texte)|(?:add|write|put|type) your (?:\w+ )?(?:introduction|text|content|summary|paragraph|title|heading|description)\b",
    re.I,
)

_SUBJECT = (
    r"(?:the|this|that|your|requested|a|an|any|our|la|le|el|o|a|l[’']|il|\s)*\s*(?:requested |current |following )?"
    r"(?:page|section|document|file|resource|rule(?: text)?|statute|opinion|search|address|url|link|site|server|service|record|item|content|text|pdf|article|chapter|form|bulletin|request|application|database|website|case|advisement|notice)s?"
    r"(?: (?:text|you (?:asked for|requested|are looking for|were looking for|want(?:ed)?|tried to (?:open|reach))|at this address|requested|itself|/\S+))*"
)
_FAILURE = (
    r"(?:(?:could|can) ?(?:not|n[’']t|no longer) be (?:found|displayed|processed|loaded|opened|reached|shown|located|retrieved|completed|served|rendered|accessed|read)|cannot be (?:found|displayed|processed|loaded|opened|reached|shown|located|retrieved|completed|served|rendered|accessed|read)|"
    r"failed to (?:load|open|render|respond)|returned (?:no content|an error|nothing)|(?:is|are) (?:not|no longer|temporarily|currently|presently) (?:available|unavailable|found|accessible|offline|here)(?: right now| at this time| at the moment)?|(?:is|are) unavailable|"
    r"(?:has|have|was|were) (?:been )?(?:moved|removed|deleted|blocked|denied|taken offline)(?: or (?:was |has been )?(?:moved|deleted|removed))?|does not exist(?: on this (?:site|server))?|doesn[’']t exist|was not found(?: on this (?:site|server))?|not found on this server|timed out|did not respond(?: in time)?|took too long to respond|is (?:empty|damaged|corrupt(?:ed)?))"
)
_APOLOGY = r"(?:we[’']re (?:very )?sorry|we are (?:very )?sorry|sorry|oops|uh[- ]?oh|unfortunately|apologies|whoops|hmm|our apologies|lo sentimos|desculpe|d[ée]sol[ée])"
_STATUS = r"(?:not found|forbidden|unauthorized|bad request|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|internal server error|too many requests|gone|method not allowed|request time-?out|access denied|moved permanently|payment required|not acceptable|conflict|proxy authentication required)"
_CODE_NO = r"(?:[345]\d\d)"
_HEAD = rf"(?:[\[(]{_CODE_NO}[\])]|(?:http )?(?:error|status|code|fehler|erreur|erro)(?: code)?:? ?#?{_CODE_NO}\b[.:,]?|http(?:/\d\.\d)?(?: error)? {_CODE_NO}\b[.:]?|{_CODE_NO}\b ?(?:[-–—:]|error\b))"
_SCRIPT = r"(?:javascript|java script|js|ecmascript|scripts?|scripting|(?:active|client-side) script(?:s|ing)|cookies)"
_SCRIPTS = rf"(?:(?:active |client-side |browser )?{_SCRIPT})(?: (?:and|or) (?:active |client-side )?{_SCRIPT})*"
_VIEWER = r"(?:the|this|our|your|please note:? this|that)\s+(?:[\w-]+\s){0,3}?(?:page|site|application|app|viewer|browser|reader|finder|website|portal|library|service|search|program|tool|form|document|content)s?"

_I = re.I
#: Messages that stand for missing content: kind and pattern.
MESSAGES: list[tuple[str, re.Pattern]] = [
    ("error_page", re.compile(rf"{_HEAD}\s*[-–—:.]?\s*(?:{_APOLOGY}[,:.!]?\s+)?(?:{_SUBJECT}\s+{_FAILURE}|{_STATUS}\b|the service is unavailable)", _I)),
    ("error_page", re.compile(rf"\b{_CODE_NO}\s+{_STATUS}\b", _I)),
    ("error_page", re.compile(rf"\b{_APOLOGY}[,:.!]?\s+(?:but )?{_SUBJECT}\s+{_FAILURE}", _I)),
    ("error_page", re.compile(
        r"the requested url \S+ was not found|you (?:don[’']t|do not) have permission to access|access (?:is |was )?denied\b(?=[.!\s]|$)|the upstream server did not respond|object moved(?: to here)?|error establishing a database connection", _I)),
    ("error_page", re.compile(
        r"traceback \(most recent call last\)|\bjava\.\w+\.\w+(?:exception|error)\b|\bat [\w.$]+\(\w+\.java:\d+\)|\bORA-\d{5}: |warning: \w+\(\) expects parameter|fatal error: (?:uncaught|call to)|mysql_\w+\(\)|\b\w+error: (?:'|cannot |name |list )|unhandled exception|stack trace:|segmentation fault|syntax error near", _I)),
    ("error_page", re.compile(
        r"your session (?:has )?(?:expired|timed out)|please log ?in again|you have been (?:rate limited|blocked|logged out)|your request (?:was|has been) blocked|too many requests|checking your (?:connection|browser) before|verify (?:that )?you are (?:a )?human|complete the captcha|unusual traffic from", _I)),
    ("error_page", re.compile(
        r"the service is unavailable\.|service temporarily unavailable|something went wrong(?: on our end)?[.!]|an? (?:unexpected|internal|unknown|application)(?: server)? error (?:has )?occurred|(?:we are |we’re |we're )?unable to (?:display|load|open|render|process) (?:this|the) (?:pdf|page|document|file|request|section|content|opinion|rule|statute)|"
        r"(?:down|offline|closed) for (?:scheduled |routine )?maintenance\. (?:please|we)|we (?:can(?:no|’|'|n’|n')?t|could(?:n’t|n't| not)) find (?:the|that|this|your) (?:page|document|file|section|record|opinion|address)", _I)),
    ("error_page", re.compile(r"\{\s*\"status\"\s*:\s*\"?\d{3}|\"error\"\s*:\s*\"", _I)),
    ("error_page", re.compile(
        r"no se (?:encontr[oó]|ha encontrado|pudo (?:encontrar|cargar|abrir)) (?:la|el) (?:p[aá]gina|documento|archivo|recurso|secci[oó]n)|p[aá]gina no encontrada|error interno del servidor|acceso denegado|servicio no disponible|la sesi[oó]n ha (?:caducado|expirado)|int[eé]ntelo (?:de nuevo|otra vez|m[aá]s tarde)", _I)),
    ("error_page", re.compile(
        r"p[aá]gina (?:n[aã]o|nao) encontrada|n[aã]o foi poss[ií]vel (?:encontrar|carregar|abrir|exibir)|erro interno (?:do|no) servidor|acesso negado|servi[cç]o indispon[ií]vel|(?:a )?sess[aã]o expir(?:ou|ada)|verifique o endere[cç]o e tente|o documento solicitado n[aã]o", _I)),
    ("error_page", re.compile(
        r"page (?:introuvable|non trouv[eé]e)|le document demand[eé] (?:n[’']existe|est introuvable)|erreur interne du serveur|acc[eè]s (?:refus[eé]|interdit)|service (?:temporairement )?indisponible|(?:votre )?session a expir[eé]|veuillez r[eé]essayer", _I)),
    ("scripts_required", re.compile(
        "|".join([
            rf"{_VIEWER}\s+(?:requires?|needs?|depends? (?:up)?on|relies? on|works? only with|only works? with|will not (?:load|work|run|open|function)(?: properly)? (?:without|unless)|cannot (?:run|load|work|be shown|be displayed|open) (?:without|unless)|can[’']t (?:run|load|work) without|does(?: not|n[’']t) (?:work|load|run)(?: properly)? (?:without|unless)|won[’']t (?:load|work|run) without)\s+(?:you (?:enable|allow) |that )?(?:{_SCRIPTS})\b",
            rf"(?:please |you (?:need|have) to |you must |kindly )(?:enable|allow|activate|turn on|switch on|permit) (?:{_SCRIPTS})\b",
            rf"(?:^|\n)\s*(?:enable|allow|activate|turn on) (?:{_SCRIPTS}) (?:to|and|in|for)\b",
            rf"\b(?:{_SCRIPTS}) (?:is|are|has been|have been|must be|needs? to be|seems? to be|appears? to be) (?:disabled|turned off|switched off|blocked|not enabled|required|needed|switched on|enabled|turned on)(?: (?:in your browser|to|for|on|before|by your)\b|[.!]?\s*(?:\n|$))",
            rf"\b(?:{_SCRIPTS}) (?:and \w+ \w+ )?(?:are|is) (?:needed|required) to (?:continue|view|use|read|display|proceed)",
            rf"(?:your|this) browser (?:does not support|has disabled|is blocking|blocks|is not running) (?:{_SCRIPTS})|work properly without (?:{_SCRIPTS})|scripting has been turned off|without scripts? enabled",
            r"noscript\s*[:>]|<noscript",
            r"(?:habilite|active|activar?|habilitar|permita) (?:el |los |la )?(?:javascript|scripts?)\b|necesita (?:javascript|scripts)|requiere javascript|es necesario habilitar",
            r"(?:ative|habilite|ativar|habilitar|permita) (?:o |os )?(?:javascript|scripts?)\b|precisa (?:de )?(?:do )?javascript|requer javascript|[ée] necess[aá]rio (?:ativar|habilitar)",
            r"(?:veuillez )?(?:activer|activez|autoriser|autorisez) (?:le |les |l[’'])?(?:javascript|scripts?)\b|n[eé]cessite (?:javascript|l[’']activation)|javascript (?:est|doit [eê]tre) (?:d[eé]sactiv[eé]|activ[eé]|requis|n[eé]cessaire)",
        ]), _I)),
    ("scripts_required", re.compile(r"browser is out of date|upgrade (?:it|your browser) or switch|loading(?:…|\.\.\.)\s*if nothing appears", _I)),
]
#: Which of them are dumps of a program, told by their notation alone.
_DUMPS = frozenset(n for n, (_, p) in enumerate(MESSAGES) if "traceback" in p.pattern or "status" in p.pattern and "error" in p.pattern and p.pattern.startswith(r"\{"))
#: A whole word without which no scripts-required notice (the detector named after it) can match;
#: ``js`` and ``script`` are parts of many other words.
_SCRIPT_WORD = re.compile(rf"(?<![^\W_])(?:no)?(?:{_SCRIPT})(?![^\W_])|activation", _I)
_SCRIPTS_REQUIRED = next(f"m{n}" for n, (_, p) in enumerate(MESSAGES) if "noscript" in p.pattern)
#: Messages only as a line (or text) of their own.
_LINE_MESSAGE = re.compile(rf"[ \t]*(?:{_SUBJECT}\s+{_FAILURE}(?=\s*(?:[.!\r\n]|$))|{_STATUS}(?=\s*(?:[.!\r\n]|$)))", _I)
_LINE_START = re.compile(r"(?:\A|[\r\n]+|(?:Español|Contact|Search)\s)")
_END = re.compile(r"[.!?…](?:[\"”’»)]*)(?=\s|$)|[\r\n]")


class _Context:
    """Sentences, paragraphs and quotation marks of one text, found once each."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def ends(self) -> list[tuple[int, int]]:
        return [m.span() for m in _END.finditer(self.text)]

    @cached_property
    def _end_stops(self) -> list[int]:
        return [e for _, e in self.ends]

    @cached_property
    def _end_starts(self) -> list[int]:
        return [s for s, _ in self.ends]

    def sentence(self, start: int, end: int) -> tuple[int, int]:
        """The sentence (or line) around a span."""
        i, k = bisect_right(self._end_stops, start), bisect_left(self._end_starts, end)
        return self._end_stops[i - 1] if i else 0, self._end_stops[k] if k < len(self.ends) else len(self.text)

    @cached_property
    def _marks(self) -> dict[str, list[int]]:
        return {c: [m.start() for m in re.finditer(re.escape(c), self.text)] for c in '\n“”«»"'}

    def _last(self, c: str, at: int) -> int:
        i = bisect_left(self._marks[c], at)
        return self._marks[c][i - 1] if i else -1

    def _next(self, c: str, at: int) -> int:
        i = bisect_left(self._marks[c], at)
        return self._marks[c][i] if i < len(self._marks[c]) else len(self.text)

    def quoted(self, at: int) -> bool:
        """Is the position inside quotation marks that open before and close after it in its paragraph?"""
        lo, hi = self._last("\n", at), self._next("\n", at)
        for left, right in ("“”", "«»"):
            opened = self._last(left, at)
            if opened > max(lo, self._last(right, at)) and self._next(right, at) < min(hi, self._next(left, at)):
                return True
        plain = self._marks['"']
        return (bisect_left(plain, at) - bisect_left(plain, lo + 1)) % 2 == 1 and self._next('"', at) < hi

    def stands(self, start: int, end: int) -> bool:
        """Does the span stand for content rather than being reported by its sentence?"""
        lo, hi = self.sentence(start, start)  # of several sentences the first one tells
        sentence, span = self.text[lo:hi].strip(), min(end, hi) - start
        if span >= MOST_OF * len(sentence):
            return True
        before = self.text[lo:start].strip()
        begins = not before or not self.text[start].islower() or before[-1] in ":|>" or not any(w[0].islower() for w in before.split())
        return begins and span >= PART_OF * len(self.text[start:hi].strip())


def _marker_spans(text: str) -> list[tuple[str, int, int]]:
    found, done = [], 0
    match = _MARKER.match
    for o in _OPENERS.finditer(text):
        at = o.start()
        if at >= done and (m := match(text, at)):
            found.append((m.lastgroup, at, m.end()))
            done = m.end()
    if any(v in text for v in _VALUES):
        found += [("value", m.start(), m.end()) for m in _VALUE.finditer(text)]
    return found


def markers(text: str, context: _Context) -> list[tuple[str, int, int]]:
    """Unfilled placeholders that are used as such."""
    found = _marker_spans(text)
    if not found:
        return []
    code = [(m.start(), m.end()) for m in _CODE.finditer(text)] if "`" in text or "<" in text else []
    opened = [lo for lo, _ in code]

    def in_code(at: int) -> bool:
        i = bisect_right(opened, at) - 1
        return i >= 0 and at < code[i][1]

    prose = [x for x in found if not in_code(x[1])]
    sentences = [context.sentence(x[1], x[2]) for x in prose]
    held = Counter(sentences)
    explains: dict[tuple[int, int], int] = {}
    for at in held:
        said = text[at[0] : at[1]]
        for x, other in zip(prose, sentences):
            if other == at:
                said = said.replace(text[x[1] : x[2]], " ")
        explains[at] = EXPLAINED * len(_ABOUT.findall(said))
    used = [x for x, at in zip(prose, sentences) if held[at] > explains[at]]
    if len(used) < LEAST_USED * len(found):
        return []
    sure = [x for x in used if x[0] != "guillemet_word"]
    # a lone word in guillemets is a marker in a sentence of a language that does not quote with them
    return sure or [x for x in used if _english(text, context, x[1], x[2])]


_ENGLISH = re.compile(r"\b(?:the|of|and|to|is|by|for|that|a|an|in|on|at)\b", re.I)


def _english(text: str, context: _Context, start: int, end: int) -> bool:
    lo, hi = context.sentence(start, end)
    return len(_ENGLISH.findall(text, lo, hi)) >= 3


def filler(text: str, low: str, hits: set[str], context: _Context) -> list[tuple[str, int, int]]:
    """Runs of dummy words, noise and repetition, and stock filler sentences."""
    out = []
    if "filler" in hits:
        for m in _FILLER.finditer(text):
            start = m.start() + len(m.group()) - len(m.group().lstrip(". \r\n\t"))
            if not context.quoted(start) and (context.stands(start, m.end()) or out):
                out.append(("stock", start, m.end()))
    words = _WORD.findall(low)
    if sum(map(_LOREM.__contains__, words)) >= 8:
        out += _runs(text, _LOREM, 8, 5, "lorem")
    if sum(map(_NOISE.__contains__, words)) >= 6:
        out += _runs(text, _NOISE, 6, 1, "noise")
    if any(map(eq, words, words[1:])):
        out += [("repeated", m.start(), m.end()) for m in _REPEAT.finditer(text)]
    return out


_REPEAT = re.compile(r"\b([^\W\d_]{2,20})(?:[ ,.]{1,2}\1\b){5,}", re.I)


def _runs(text: str, words: frozenset[str], least: int, distinct: int, kind: str) -> list[tuple[str, int, int]]:
    out, start, end, n, seen = [], 0, 0, 0, set()
    for m in _WORD.finditer(text):
        if m.group().lower() in words:
            if not n:
                start = m.start()
            n += 1
            seen.add(m.group().lower())
            end = m.end()
        else:
            if n >= least and len(seen) >= distinct:
                out.append((kind, start, end))
            n, seen = 0, set()
    if n >= least and len(seen) >= distinct:
        out.append((kind, start, end))
    return out


def messages(text: str, hits: set[str], context: _Context) -> list[tuple[str, int, int]]:
    """Error messages and scripts-required notices standing in place of content."""
    out = []
    for n, (kind, pattern) in enumerate(MESSAGES):
        if f"m{n}" not in hits:
            continue
        for m in pattern.finditer(text):
            s, e = m.start(), m.end()
            if (cut := text.rfind("\n\n", s, e)) >= 0:  # the end of what stood before
                s = cut + 2
            while s < e and text[s].isspace():
                s += 1
            if not context.quoted(s) and (n in _DUMPS or context.stands(s, e)):
                out.append((kind, s, e))
    if "line" in hits:
        for line in _LINE_START.finditer(text):
            if (m := _LINE_MESSAGE.match(text, line.end())) and not context.quoted(m.start()) and context.stands(m.start(), m.end()):
                out.append(("error_page", m.start(), m.end()))
    return out


#: Most texts that a stretch of a pattern is spelled out to.
_MOST_SPELLED = 600


def _spelled(items, most: int = _MOST_SPELLED) -> set[str] | None:
    """All texts (in lower case) that a parsed pattern matches, None if they are too many."""
    out = {""}
    for op, arg in items:
        if (one := _spelled_item(op, arg)) is None or len(out) * len(one) > most:
            return None
        out = {a + b for a in out for b in one}
    return out


def _spelled_item(op, arg) -> set[str] | None:
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}
    if op is sre.IN and all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg):
        found = {chr(c).lower() for o, v in arg for c in ((v,) if o is sre.LITERAL else range(v[0], v[1] + 1))}
        return found if len(found) <= 4 else None
    if op is sre.BRANCH:
        each = [_spelled(x) for x in arg[1]]
        return None if any(x is None for x in each) else set().union(*each)
    if op is sre.SUBPATTERN:
        return _spelled(arg[3])
    if op is sre.MAX_REPEAT and arg[1] == 1:
        one = _spelled(arg[2])
        return one if one is None or arg[0] else one | {""}
    return None


def _needed(items) -> set[str] | None:
    """Texts of which every match of a parsed pattern holds one, as long as can be; None if there
    are no such texts."""
    found: list[set[str]] = []
    run = {""}
    for op, arg in items:
        one = _spelled_item(op, arg)
        if one is not None and len(run) * len(one) <= _MOST_SPELLED:
            run = {a + b for a in run for b in one}
            continue
        found.append(run)
        run = one or {""}
        if op is sre.BRANCH:
            each = [_needed(x) for x in arg[1]]
            if all(each):
                found.append(set().union(*each))
        elif op is sre.SUBPATTERN and (inner := _needed(arg[3])):
            found.append(inner)
        elif op is sre.MAX_REPEAT and arg[0] and (inner := _needed(arg[2])):
            found.append(inner)
    found = [x for x in [*found, run] if all(x)]
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def _hints() -> dict[str, set[str]]:
    """Which detectors each hint calls: the hints are taken from the patterns themselves, so every
    alternative holds one."""
    of: dict[str, set[str]] = {}
    for name, pattern in ({f"m{n}": p for n, (_, p) in enumerate(MESSAGES)} | {"filler": _FILLER, "line": _LINE_MESSAGE}).items():
        for h in _needed(sre.parse(pattern.pattern, pattern.flags)):
            of.setdefault(h, set()).add(name)
    return of


_AUTOMATON = None


def _hits(low: str) -> set[str]:
    """The detectors whose hints are in the text: one pass over it for all of them."""
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        _AUTOMATON = ahocorasick.Automaton()
        for h, names in _hints().items():
            _AUTOMATON.add_word(h, frozenset(names))
        _AUTOMATON.make_automaton()
    return set().union(*(names for _, names in _AUTOMATON.iter(low)))


def residue(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of everything in a text that stands for missing content, in order."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # positions must agree
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    hits, context = _hits(low), _Context(text)
    if _SCRIPTS_REQUIRED in hits and not _SCRIPT_WORD.search(low):
        hits.discard(_SCRIPTS_REQUIRED)
    found = [("template_" + k, s, e) for k, s, e in markers(text, context)]
    found += [("filler_" + k, s, e) for k, s, e in filler(text, low, hits, context)]
    found += messages(text, hits, context)
    return sorted(found, key=lambda x: x[1:])


def find_residue(documents: DataFrame, keep: list[str], text: str = "text", clean: bool | None = False) -> DataFrame:
    """Rows with residue: ``keep`` columns, ``residue`` (distinct kinds, joined), ``n_residue`` and
    the first one's text; with ``clean`` the rows without any instead, as they are."""
    names = [c for c in (documents.columns if clean else keep)]
    if clean:
        schema = documents.schema
        at = names.index(text)
    else:
        names = [c for c in names if c not in ("residue", "example")]
        schema = StructType([documents.schema[c] for c in names] + [StructField("residue", StringType()), StructField("example", StringType())])
        at = len(names)
    source = documents if clean else documents.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kinds, examples = [], [], []
            for r, t in enumerate(b.column(at).to_pylist()):
                found = residue(t)
                if bool(found) == bool(clean):
                    continue
                rows.append(r)
                if not clean:
                    kinds.append(",".join(sorted({k for k, *_ in found})))
                    examples.append(t[found[0][1] : found[0][2]][:200])
            took = b.take(pa.array(rows, pa.int64()))
            if clean:
                yield took
            else:
                cols = [took.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kinds, pa.string()), pa.array(examples, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)
