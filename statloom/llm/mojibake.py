"""Garbled text from a wrong character encoding, restored by minimum description length.

Every run of suspicious characters has candidate decodings: chains of (encode with the wrong code
page, decode with the right one), layer by layer, also through HTML entities.  A chain's
description length is the size of the runs in their contexts after the chain, compressed by
Zstandard with the dictionary of each language (the best one counts), plus a cost for each step of
the chain.  The chain of least description length is applied to all runs of the text that it can
decode; this is repeated on what is left; where nothing is shorter than the text as it stands, the
text is left unchanged.

The dictionaries are trained on the corpus (:func:`fit`): runs with the characters around them are
counted over all texts in which no run can be undone, and the ``MOST_WINDOWS`` commonest of each
language train its dictionary, which is all the driver sees.  Lost signs (replacement characters,
also behind the lead bytes that were left of them) are filled by the same dictionaries with the run
that describes the place best, where one is better than all others; else they are reported as lost.

Defined edge cases: null and empty texts are sound; correct foreign words and symbols, entities of
the right character and misread letters of scans stay as they are; texts of any length are handled
whole; repeated rows give repeated results; a language without texts has an empty dictionary.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from statloom.session import ensure_checkpoint_dir

#: Bytes charged for each step of a chain and for a step between one-byte code pages, the least gain
#: that justifies a chain, and the least by which a filling must beat all others.
STEP_COST, SINGLE_COST, LEAST_GAIN, SURE = 1, 1, 1, 1

#: Languages with a dictionary of their own, windows that train one, its size in bytes, and how much
#: rarer than its one-byte decoding a window must be to count as damaged.
LANGUAGES = ("en", "es", "pt", "fr", "other")
MOST_WINDOWS, DICTIONARY_BYTES, RARER = 3000, 32_768, 4
#: A sign is common, and not searched by itself, if this share of the texts hold it.
COMMON = 0.05
#: Distinct counts a worker holds before it hands them on.
_HELD = 200_000

#: Bytes charged for a sign that a language's dictionary does not hold.
ESCAPE_COST = 1

#: Wrong reading of UTF-8 bytes, then wrong reading of Windows-1252 (Latin-1) bytes.
STEPS: list[tuple[str, str]] = [
    ("cp1252", "utf-8"), ("latin-1", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("cp1251", "utf-8"), ("gbk", "utf-8"), ("cp932", "utf-8"),
    ("cp1250", "utf-8"), ("koi8-r", "utf-8"), ("iso8859-15", "utf-8"), ("big5", "utf-8"), ("cp1253", "utf-8"), ("cp1254", "utf-8"),
    ("latin-1", "cp1252"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "mac_roman"), ("cp1250", "cp1252"), ("koi8-r", "cp1252"), ("cp1253", "cp1252"),
]

_LEVEL = 19

#: A run: non-ASCII characters and entities next to each other (letters may stand between accents).
_RUN = re.compile(r"(?:[^\x00-\x7f�]|&(?:#\d{2,5}|#x[0-9a-fA-F]{2,4}|[A-Za-z]{2,8}\d{0,2});)+")
_ENTITY = re.compile(r"&(?:#\d{2,5}|#x[0-9a-fA-F]{2,4}|[A-Za-z]{2,8}\d{0,2});")
_CONTEXT = 5
_AROUND = 8


def _wide(text: str) -> bytes:
    """Two bytes a character, so that no sign is cheaper than another before compression."""
    return text.encode("utf-16-le", "surrogatepass")


class Model:
    """Per language a compressor with its trained dictionary and the dictionary's alphabet; the
    commonest runs; and the signs that are common in the texts to restore."""

    def __init__(self, dictionaries: dict[str, tuple[bytes, bool, str]], runs: tuple[str, ...] = (), common: str = ""):
        self.parts = (dictionaries, runs, common)
        params = zstandard.ZstdCompressionParameters.from_level(_LEVEL, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.languages: list[tuple[zstandard.ZstdCompressor, frozenset[str]]] = []
        for data, trained, alphabet in dictionaries.values():
            how = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
            given = {"dict_data": zstandard.ZstdCompressionDict(data, dict_type=how)} if len(data) >= 8 else {}
            self.languages.append((zstandard.ZstdCompressor(compression_params=params, **given), frozenset(alphabet)))
        self.alphabet = frozenset().union(*(a for _, a in self.languages))
        self.runs, self.common = runs, frozenset(common)
        self._lengths: dict[str, int] = {}

    def description_length(self, text: str) -> int:
        """Bytes of the text under the language dictionary that fits it best; a sign outside the
        dictionary's alphabet has to be spelled out, which costs ``ESCAPE_COST`` more."""
        known = self._lengths.get(text)
        if known is not None:
            return known
        data, signs = _wide(text), [c for c in text if c > "\x7f" and c != "\u00a0"]
        length = min((len(c.compress(data)) + ESCAPE_COST * sum(s not in alphabet for s in signs) for c, alphabet in self.languages), default=len(data))
        if len(text) < 50:  # windows of single places come again and again
            if len(self._lengths) > 100_000:
                self._lengths.clear()
            self._lengths[text] = length
        return length

    def suspicious(self, run: str) -> bool:
        return any(c not in self.common for c in run)


def train(windows: dict[str, list[tuple[str, str, str, int]]], common: str = "") -> Model:
    """The model of (left, run, right, count) windows by language, the commonest first."""
    dictionaries, runs = {}, Counter()
    for lang, rows in windows.items():
        count = {(left, run, right): n for left, run, right, n in rows}
        texts: list[bytes] = []
        signs: Counter = Counter()
        for (left, run, right), n in count.items():
            ways = (decoded(run, s, left[-1:] or " ", right[:1] or " ") for s in STEPS if s[1] != "utf-8")
            if any(count.get((left, w, right), 0) >= RARER * n for w in ways if w):
                continue  # a one-byte garbling of a commoner window
            texts += [_wide(left + run + right)] * min(n.bit_length(), 12)
            signs.update(dict.fromkeys(run, n))
            runs[run] += n
        trained = False
        data = b"".join(reversed(list(dict.fromkeys(texts))))  # nearest last is cheapest to refer to
        try:
            data, trained = zstandard.train_dictionary(DICTIONARY_BYTES, texts, level=_LEVEL).as_bytes(), True
        except zstandard.ZstdError:  # too few texts to train on: they are the dictionary themselves
            pass
        dictionaries[lang] = (data, trained, "".join(sorted(signs)))
    return Model(dictionaries, tuple(r for r, _ in runs.most_common()), common)


def _bytes(text: str, encoding: str) -> bytes | None:
    """The bytes that were read as this text; bytes a code page leaves open stay as they are."""
    out = bytearray()
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        pass
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if 0x80 <= ord(c) <= 0x9F or (ord(c) == 0xA0 and encoding in ("cp932", "gbk", "big5")):
                out.append(ord(c))
            else:
                return None
    return bytes(out)


@lru_cache(maxsize=200_000)
def decoded(run: str, step: tuple[str, str], left: str = " ", right: str = " ") -> str | None:
    """A run after one step, or None where the step cannot have made it."""
    wrong, good = step
    data = _bytes(run, wrong)
    if data is None:
        return None
    if good == "utf-8":
        if not any(b >= 0xC2 for b in data):
            return None
        try:
            out = data.decode("utf-8")
        except UnicodeDecodeError:
            return _partly(data, wrong)
        return out if out != run and _printable(out) else None
    if any(c in "­¬‐‑" for c in run):  # the hyphens of scans
        return None
    try:
        out = data.decode(good)
    except UnicodeDecodeError:
        return None
    ends = [left, *out, right]
    return None if out == run or not _printable(out) or not all(_fits(*x) for x in zip(ends[1:-1], ends, ends[2:])) else out


def _partly(data: bytes, wrong: str) -> str | None:
    """Bytes of which some sequences are UTF-8: lone bytes keep their wrong reading, an opening
    ``Â`` or ``â€`` whose rest was dropped gives the blank or quotation mark it must have been."""
    out, i, good = [], 0, 0
    while i < len(data):
        n = 2 if 0xC2 <= data[i] < 0xE0 else 3 if 0xE0 <= data[i] < 0xF0 else 4 if 0xF0 <= data[i] < 0xF5 else 1
        part = data[i : i + n]
        if n > 1:
            try:
                out.append(part.decode("utf-8"))
                good += 1
                i += n
                continue
            except UnicodeDecodeError:
                if part == b"\xe2\x80" and wrong in ("cp1252", "latin-1"):
                    out.append("”")
                    good += 1
                    i += 2
                    continue
                if data[i] == 0xC2 and good and i == len(data) - 1:
                    i += 1  # the non-breaking blank became a plain one that follows
                    continue
        try:
            out.append(data[i : i + 1].decode(wrong))
        except UnicodeDecodeError:
            return None
        i += 1
    text = "".join(out)
    return text if good and _printable(text) else None


def _printable(text: str) -> bool:
    return not any(c < " " or c == "�" for c in text)


def _fits(c: str, left: str, right: str) -> bool:
    """May this sign stand between these neighbours?"""
    if c == "’":
        return left.isalnum() and (right.isalpha() or not right.isalnum())
    if c in "“‘":
        return (not left.isalnum()) and (right.isalnum() or right in "$[(¿")
    if c == "”":
        return (left.isalnum() or left in ".,;:!?)’%") and not right.isalnum()
    if c in "—–":
        return not left.isspace() or right.isspace() or right.isalnum()
    if c == "§":
        return not left.isalnum() and not right.isalpha()
    if c in "½¼¾":
        return not left.isalpha() and not right.isalpha()
    if c in "¢°":
        return left.isdigit()
    if c.isalpha():
        return left.isalpha() or right.isalpha()
    return True


class Restored:
    """A text, the chains that were undone, and what stays lost."""

    __slots__ = ("text", "chains", "lost", "found")

    def __init__(self, text: str):
        self.text, self.chains, self.lost, self.found = text, [], 0, False


def _windows(text: str, runs: list[re.Match], done: list[str]) -> str:
    """The distinct runs as they would read, each with a few characters around it."""
    return "".join(dict.fromkeys(text[max(0, m.start() - _CONTEXT) : m.start()] + d + text[m.end() : m.end() + _CONTEXT] for m, d in zip(runs, done)))


def _candidates(runs: list[re.Match], text: str, model: Model) -> list[tuple[int, str, list[str]]]:
    """(layers, name, decoded runs) of every chain that changes some run."""
    plain = [m.group() for m in runs]
    around = [(text[m.start() - 1] if m.start() else " ", text[m.end()] if m.end() < len(text) else " ") for m in runs]
    # entities of one character are sound; several in a row, or beside other signs, may be bytes
    opened = [html.unescape(r) if "&" in r and (len(_ENTITY.findall(r)) > 1 or len(_ENTITY.sub("", r))) else r for r in plain]
    chains: list[tuple[int, str, list[str]]] = []
    for step in STEPS:
        now = [r if "&" not in r else p for r, p in zip(opened, plain)]
        layer = 0
        while True:
            new = [d if (d := decoded(r, step, *a)) is not None else r for r, a in zip(now, around)]
            if step[1] != "utf-8":
                new = [n if all(c in model.alphabet or c == "\u00a0" for c in n) else o for n, o in zip(new, now)]
            if new == now:
                break
            layer += 1
            now = new
            done = [n if n != o else p for n, o, p in zip(now, opened, plain)]
            name = ("html>" if any("&" in p and n != p for p, n in zip(plain, done)) else "") + f"{step[0]}>{step[1]}" + (f"x{layer}" if layer > 1 else "")
            chains.append((layer, name, done))
            if step[1] != "utf-8":
                break  # a second one-byte step would only permute signs
    return chains


_LOST = re.compile(r"[^\x00-\x7f\ufffd]{0,3}\ufffd+[^\x00-\x7f\ufffd]{0,2}")


def _fillings(lost: str, model: Model) -> list[str]:
    """Runs of the model that the loss may have left like this: by the lead bytes that still stand, or
    by the number of bytes (or of one-byte signs) that are gone."""
    n = lost.count("\ufffd")
    head, tail = lost.split("\ufffd", 1)[0], lost.rsplit("\ufffd", 1)[1]
    out = []
    for run in model.runs:
        if not head and not tail:
            fits = len(run) == n or len(run.encode("utf-8", "ignore")) == n or (len(run) == 1 and n <= 4)
        else:
            fits = run.startswith(head) and run.endswith(tail) and len(run) > len(head) + len(tail)
        if not fits and head and not tail:
            for wrong, good in STEPS:
                if good == "utf-8" and (data := _bytes(head, wrong)) and data[0] >= 0xC2 and run.encode("utf-8", "ignore").startswith(data) and len(run.encode("utf-8", "ignore")) > len(data):
                    fits = True
                    break
        if fits:
            out.append(run)
    return out


def fill_lost(text: str, model: Model) -> tuple[str, list[str]]:
    """Fills lost signs where one run describes the place better than all others and than the loss."""
    parts, at, filled = [], 0, []
    for m in _LOST.finditer(text):
        ways = _fillings(m.group(), model)
        if not ways:
            continue
        left, right = text[max(0, m.start() - _AROUND) : m.start()], text[m.end() : m.end() + _AROUND].split("\ufffd")[0]
        if "\ufffd" in left:
            left = ("".join(parts) + text[at : m.start()])[-_AROUND:]
        ranked = sorted((model.description_length(left + w + right), i) for i, w in enumerate(ways))
        if ranked[0][0] + LEAST_GAIN <= model.description_length(left + m.group() + right) and (len(ranked) == 1 or ranked[0][0] + SURE <= ranked[1][0]):
            parts += [text[at : m.start()], ways[ranked[0][1]]]
            at = m.end()
            filled.append(f"lost>{ways[ranked[0][1]]}")
    return "".join(parts) + text[at:], filled


def restore(text: str, model: Model) -> Restored:
    """Undoes wrong decodings in a text as far as that makes it shorter to describe."""
    out = Restored(text)
    if text.isascii() and "&" not in text:
        return out
    while runs := [m for m in _RUN.finditer(text) if model.suspicious(m.group())]:  # every round shortens the description
        best = None
        if chains := _candidates(runs, text, model):
            stays = model.description_length(_windows(text, runs, [m.group() for m in runs]))
            for layer, name, done in chains:
                length = model.description_length(_windows(text, runs, done)) + STEP_COST * layer + (0 if ">utf-8" in name else SINGLE_COST)
                if length + LEAST_GAIN <= stays and (best is None or length < best[0]):
                    best = (length, name, done)
        if best is None:
            break
        out.chains.append(best[1])
        out.found = True
        parts, at = [], 0
        for m, d in zip(runs, best[2]):
            parts += [text[at : m.start()], d]
            at = m.end()
        text = "".join(parts) + text[at:]
    if "\ufffd" in text:
        out.found = True
        text, filled = fill_lost(text, model)
        out.chains += filled
    out.lost = sum(1 for c in text if c == "\ufffd" or "\x80" <= c <= "\x9f")
    out.found = out.found or out.lost > 0
    out.text = text
    return out


def undamaged(text: str) -> bool:
    """Has the text no sign of loss, and no run that was UTF-8 once?"""
    if "\ufffd" in text or any("\x80" <= c <= "\x9f" for c in text):
        return False
    return not any(decoded(r, s) is not None for r in set(_SIGNS.findall(text)) for s in STEPS if s[1] == "utf-8")


_SIGNS = re.compile(r"[^\x00-\x7f]+")


def fit(texts: DataFrame, others: DataFrame | None = None, lang: str = "lang", text: str = "text") -> Model:
    """Dictionaries from all undamaged texts of ``texts`` (those to restore) and ``others``, by the
    language in ``lang``; common signs from ``texts``."""
    pick = lambda df, own: df.select(F.lit(own).alias("own"), F.substring(F.lower(F.trim(F.col(lang).cast("string"))), 1, 2).alias("lang"), F.col(text).cast("string").alias("t"))
    source = pick(texts, True) if others is None else pick(texts, True).unionByName(pick(others, False))
    source = source.where("t is not null and t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            cols = list(zip(*held)) or [()] * 4
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols] + [pa.array(list(held.values()), pa.int64())], names=["lang", "lft", "run", "rgt", "n"])
            held.clear()
            return batch

        for b in batches:
            for own, lang_, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                if own:
                    held["", "", "", ""] += 1
                if t.isascii() or not undamaged(t):
                    continue
                lang_ = lang_ if lang_ in LANGUAGES else LANGUAGES[-1]
                for m in _SIGNS.finditer(t):
                    held[lang_, t[max(0, m.start() - _AROUND) : m.start()], m.group(), t[m.end() : m.end() + _AROUND]] += 1
                if own:
                    for c in {c for c in t if c > "\x7f"}:
                        held["", "", c, ""] += 1
                if len(held) > _HELD:
                    yield out()
        yield out()

    ensure_checkpoint_dir(texts.sparkSession)
    counts = source.mapInArrow(run, "lang string, lft string, run string, rgt string, n long").groupBy("lang", "lft", "run", "rgt").agg(F.sum("n").alias("n")).checkpoint()
    signs = {r["run"]: r["n"] for r in counts.where("lang = ''").select("run", "n").collect()}  # as many rows as there are signs
    common = "".join(sorted(c for c, n in signs.items() if c and n >= COMMON * signs.get("", 0)))
    windows = {}
    for name in LANGUAGES:
        rows = counts.where(F.col("lang") == name).orderBy(F.desc("n"), "lft", "run", "rgt").limit(MOST_WINDOWS).collect()
        windows[name] = [(r["lft"], r["run"], r["rgt"], r["n"]) for r in rows]
    return train(windows, common)


def restore_texts(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The garbled rows: ``keep`` columns, chains undone, characters still lost, what came of it
    (``restored``, ``partly`` or ``lost``: damage was seen, nothing could be undone), the restored text."""
    extra = [StructField("chains", ArrayType(StringType())), StructField("n_lost", IntegerType()), StructField("outcome", StringType()), StructField("restored_text", StringType())]
    names = [c for c in keep if c not in {f.name for f in extra}]
    schema = StructType([df.schema[c] for c in names] + extra)
    source = df.select(*[F.col(f"`{c}`") for c in names], F.col(text).cast("string").alias("__text"))

    parts = model.parts  # a few hundred KB: see MOST_WINDOWS and DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*parts)
        for b in batches:
            rows, chains, lost, outcome, texts = [], [], [], [], []
            for r, t in enumerate(b.column(len(names)).to_pylist()):
                if t and (x := restore(t, m)).found:
                    rows.append(r)
                    chains.append(x.chains)
                    lost.append(x.lost)
                    outcome.append("restored" if not x.lost else "partly" if x.chains else "lost")
                    texts.append(x.text)
            kept = b.take(pa.array(rows, pa.int64()))
            cols = [kept.column(i) for i in range(len(names))]
            cols += [pa.array(chains, pa.list_(pa.string())), pa.array(lost, pa.int32()), pa.array(outcome, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return source.mapInArrow(run, schema)
