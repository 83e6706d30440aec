"""Noise in text from scanned pages: a noisy channel and page furniture, both learned from the corpus.

1. Every distinct text is counted once (copies share its weight): the texts that hold a word, two
   neighbouring words or a compound, and the shapes of short lines
   that stand by themselves, with how often a line of that shape interrupts a sentence.
2. Words whose glyphs are made of the same strokes are joined on that stroke key; where one is far
   rarer, the aligned glyph groups are confusions.  Their probabilities are estimated from all such
   pairs, relative to how often the true group occurs.  A word is a suspect, with all candidates
   that its own count does not outweigh.
3. Every text is read for runs of suspects, words broken at line ends, spaced-out words and lines
   standing by themselves.  Suspects are recognised by a hashed bitmap of fixed size, which lets
   some others through; those have no candidates and drop out when the candidates are joined.
4. Each distinct run, with the words before and after it, is decoded once by Viterbi over candidates
   (channel cost plus pair likelihood from the joined pair counts).
5. Furniture is what has a shape that interrupts sentences; it is cut out, broken words and misread
   ones are replaced, and hard lines become paragraphs.

Nothing that grows with the corpus is collected or broadcast: counts, candidates, shapes and edits
are joined; the driver sees one row a confusion (glyph groups of up to three strokes glyphs, a
finite set) and the bitmap (``BITMAP_BITS``).

Defined edge cases: null and empty texts are no scans and stay as they are; texts of any length are
handled whole; hyphens of compounds, lists of numbers, mentions of pages and hard line breaks alone
are no traces; repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from statloom.session import ensure_checkpoint_dir

#: The strokes a scanner sees in each glyph.
STROKES = {
    "i": "i", "l": "i", "1": "i", "|": "i", "!": "i", "t": "i", "f": "i", "j": "i", "r": "i", "n": "ii", "u": "ii", "h": "ii", "m": "iii", "w": "vv",
    "c": "c", "e": "c", "o": "c", "0": "c", "ó": "c", "d": "ci", "b": "ic", "k": "ic", "6": "ic", "8": "ic", "g": "g", "q": "g", "9": "g", "s": "s", "5": "s", "z": "z", "2": "z",
    "ﬁ": "ii", "ﬂ": "ii",
}
#: The second reading of glyphs that have two, and letters that may be digits.
SECOND = {"b": "ii"}
LIKE_DIGITS = {"o": "0", "l": "1", "i": "1", "s": "5", "b": "8", "z": "2", "g": "9", "q": "9"}
#: Glyphs of a group on either side of a confusion.
GROUP = 3
#: How much rarer than its candidate a suspect must be, how much likelier a misreading is within a
#: misread page than over the corpus (nats), and the most that a further kind of confusion, and the
#: same one again, cost in a word: a page that misreads once does so again.
RARER, PAGE_GAIN, FURTHER, AGAIN = 4.0, 3.0, 3.0, 0.7
#: Count of a word seen nowhere else, and weight of single words against pairs.
UNSEEN, BACKOFF = 0.05, 50.0
#: A shape of line is furniture if this share of its lines, and those of ``LEAST_TEXTS`` different
#: texts, interrupt a sentence.
LEAST_INTERRUPTING, LEAST_TEXTS = 0.2, 2
#: Words that no running line has, and most lines of a title.
RUNNING_WORDS, TITLE_LINES = 10, 30
#: Size of the bitmap of suspects.
BITMAP_BITS = 1 << 26
#: Words whose class a worker remembers between texts (only a cache).
_REMEMBERED = 500_000
#: Distinct counts a worker holds before it hands them on.
_HELD = 400_000

#: Hyphens that end a line and are never part of the wording, and signs beside which a word is whole.
SOFT = "­¬‐‑"
_SOUND = "’‘“”—–…§½¼¾°¢£€ «»¿¡•" + SOFT
_WORD = re.compile(r"[^\W_]+(?:[|!][^\W_]+)*")
_PLAIN = re.compile(r"\w+")
_HYPHEN = re.compile(r"-(?<=[^\W\d_]-)(?=([^\W\d_]+))")
_LINE_MARK = re.compile(r"(?<=[^\W\d_])([-­¬‐‑]|[^\w\s.,;:!?)\]”’\"'(]{1,6}|[^\x00-\x7f]{1,6}\??|\?)[ \t]*\r?\n((?:[^\n]{0,80}\n){0,8}?)[ \t]*([^\W\d_]+)")  # up to eight lines between
_NO_MARK = frozenset(".,;:!)]”’\"'(")
_MAY_BE_SPACED = re.compile(r"[ \n]\w[ \n]\w[ \n]\w(?!\w)")
_SPACED = re.compile(r"(?<![^\s(“\"])(?:[^\W\d_](?: |\n)){3,}[^\W\d_](?![^\s.,;:)”])")
_NUMBERED = re.compile(r"\d(?:[\dA-Z.,]*\d)?")
_ROMAN = re.compile(r"[ivxl]{1,6}|[IVXL]{1,6}")
_ENDED = frozenset(".!?:”\"")


class _Normal(dict):
    """The form a word is counted in: digits are masked unless letters prevail."""

    def __missing__(self, word: str) -> str:
        if len(self) > _REMEMBERED:
            self.clear()
        digits = sum(map(str.isdigit, word))
        out = re.sub(r"\d", "#", word) if digits and digits * 2 >= len(word) + (len(word) > 3) else word
        self[word] = out
        return out


_normal = _Normal()


def lowered(text: str) -> str:
    """Lower case with the same positions."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


@lru_cache(maxsize=200_000)
def stroke_keys(word: str) -> tuple[str, ...]:
    """What words that may be read as each other share; none for words that are left alone."""
    if len(word) < 2 or not re.search(r"[^\W\d_]|#", word):
        return ()
    if "#" in word:
        return ("#" + "".join("#" if c in LIKE_DIGITS else c for c in word),)
    first = "".join(STROKES.get(c, c) for c in word)
    keys = [first]
    if any(c in SECOND for c in word):
        keys.append("".join(SECOND.get(c) or STROKES.get(c, c) for c in word))
    return tuple(keys)


@lru_cache(maxsize=200_000)
def _same_strokes(a: str, b: str) -> bool:
    return not set(stroke_forms(a)).isdisjoint(stroke_forms(b))


@lru_cache(maxsize=200_000)
def stroke_forms(group: str) -> tuple[str, ...]:
    first = "".join(STROKES.get(c, c) for c in group)
    return (first, "".join(SECOND.get(c) or STROKES.get(c, c) for c in group))


def align(seen: str, true: str) -> list[tuple[str, str]] | None:
    """The fewest confusions (seen glyphs, true glyphs) that turn the true word into the seen one."""
    if "#" in true:
        if len(seen) != len(true) or any(s != t and not (t == "#" and s in LIKE_DIGITS) for s, t in zip(seen, true)):
            return None
        return [(s, t) for s, t in zip(seen, true) if s != t]
    n, m = len(seen), len(true)
    best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(n + 1)]
    best[0][0] = (0.0, 0, 0)
    for i in range(n + 1):
        for j in sorted(best[i]):
            cost = best[i][j][0]
            if i < n and j < m and seen[i] == true[j]:
                if cost < best[i + 1].get(j + 1, (math.inf,))[0]:
                    best[i + 1][j + 1] = (cost, i, j)
                continue_same = True
            else:
                continue_same = False
            for a in range(1, GROUP + 1):
                for b in range(1, GROUP + 1):
                    if i + a > n or j + b > m or (continue_same and a == b == 1):
                        continue
                    s, t = seen[i : i + a], true[j : j + b]
                    if s == t or (a > 1 and b > 1) or not _same_strokes(s, t):
                        continue
                    c = cost + 1 + 0.1 * (a + b)
                    if c < best[i + a].get(j + b, (math.inf,))[0]:
                        best[i + a][j + b] = (c, i, j)
    if m not in best[n]:
        return None
    ops, i, j = [], n, m
    while i or j:
        _, pi, pj = best[i][j]
        if seen[pi:i] != true[pj:j]:
            ops.append((seen[pi:i], true[pj:j]))
        i, j = pi, pj
    return ops[::-1]


def channel_cost(ops: list[tuple[str, str]], costs: dict[tuple[str, str], float]) -> float:
    """Nats of a word's confusions: the dearest in full, the others by what a page has shown."""
    each = sorted((costs.get(o, 12.0) for o in set(ops)), reverse=True)
    return each[0] + sum(min(c, FURTHER) for c in each[1:]) + AGAIN * (len(ops) - len(each)) if each else 0.0


# --- lines -------------------------------------------------------------------------------------


def shape_of(line: str, before: str) -> str:
    """What running lines have in common: numbers are masked, and words repeated from an earlier line."""
    low = line.lower()
    mark = ""
    if line[-1] in ".;,:”" or not any(map(str.isalpha, line)):  # a piece of a sentence is no running title
        return re.sub(r"\s+", " ", _NUMBERED.sub("#", line))
    if len(line) > 3 and low in before:
        return "@"
    if before and " " in line:
        words = line.split(" ")
        for k in range(len(words) - 1, 0, -1):
            head = " ".join(words[:k]).rstrip(",")
            if len(head) > 5 and head.lower() in before:
                mark, line = "@", line[len(head) :]
                break
    if _ROMAN.fullmatch(line):
        return "roman"
    return mark + re.sub(r"\s+", " ", _NUMBERED.sub("#", line))


def lone_lines(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, shape, interrupts) of short lines that stand by themselves."""
    raw: list[tuple[int, str]] = []
    at = 0
    for part in text.split("\n"):
        for page in part.split("\f") if "\f" in part else (part,):
            raw.append((at, page))
            at += len(page) + 1
    lengths = sorted(len(x) for _, x in raw if len(x) > 30)
    width = lengths[int(len(lengths) * 0.8)] if lengths else max(len(x) for _, x in raw)
    lone: list[int] = []
    stripped = [x.strip() for _, x in raw]
    last = len(raw) - 1
    for i, s in enumerate(stripped):
        n = len(s)
        if not n or n > 80 or s.count(" ") >= RUNNING_WORDS or (s[0].islower() and n > 12 and not s[:3].startswith(("p.", "pg"))):
            continue
        after = stripped[i + 1] if i < last else ""
        if after and i and stripped[i - 1] and n + 1 + len(after.split(" ", 1)[0]) > width - 2:
            continue
        lone.append(i)
    out = []
    isolated = set(lone)
    body = [i for i, s in enumerate(stripped) if s and i not in isolated]
    before, heads, k = "", 0, 0
    for i in lone:
        s = stripped[i]
        while k < len(body) and body[k] < i:
            k += 1
        a, b = body[k - 1] if k else -1, body[k] if k < len(body) else last + 1
        stops = a >= 0 and b <= last and stripped[a][-1] not in _ENDED and stripped[b][0].islower()
        shape = shape_of(s, before)
        if shape in ("#", "roman"):  # lists of numbers
            near = [stripped[x] for x in (i - 1, i + 1) if 0 <= x <= last]
            if any(_NUMBERED.sub("#", x) == "#" for x in near) or (i and stripped[i - 1].endswith(":")) or len(s) > 4:
                shape += " in a list"
        start = raw[i][0] + raw[i][1].index(s)
        out.append((start, start + len(s), shape, stops))
        if a < 0 and body and heads < TITLE_LINES:  # the title block: what stands before the first line of the body
            before += "\n" + s.lower()
            heads += 1
    return out


def _letters_before(text: str, at: int) -> int:
    """Where the letters that end at a position begin."""
    k = at
    while k and text[k - 1].isalpha():
        k -= 1
    return k


def broken_words(text: str) -> list[tuple[int, int, str, str, str, str]]:
    """(start, end, left part, mark, lines between, right part) of words that a line end may have broken."""
    out = []
    at = text.find("\n")
    while at > 0:
        k = at - 1
        while k > 0 and text[k] in " \t\r":
            k -= 1
        last = text[k]
        if not (last.isascii() and last.isalnum()) and last not in _NO_MARK:  # a mark of up to six signs ends here
            for back in range(max(0, k - 6), k + 1):
                if (m := _LINE_MARK.match(text, back)) and m.end(1) == k + 1:
                    left = _letters_before(text, m.start())
                    out.append((left, m.end(), text[left : m.start()], m.group(1), m.group(2), m.group(3)))
                    break
        at = text.find("\n", at + 1)
    return out


def spaced_words(text: str) -> list[re.Match]:
    return list(_SPACED.finditer(text)) if _MAY_BE_SPACED.search(text) else []


def words_of(low: str) -> list[str]:
    return (_WORD if "|" in low or "!" in low or "_" in low else _PLAIN).findall(low)


# --- counting ----------------------------------------------------------------------------------


#: Most digests of repeated texts that are broadcast; more are joined by a shuffle.
MOST_COPIED = 1_000_000


def weighted(keyed: DataFrame) -> DataFrame:
    """(t, weight) of (tkey, t) rows: copies of a text share the weight 1.  Only digests are shuffled,
    and only those of repeated texts come back."""
    copies = keyed.groupBy("tkey").agg(F.count("*").alias("copies")).where("copies > 1").checkpoint()
    few = copies.limit(MOST_COPIED + 1).count() <= MOST_COPIED
    return keyed.join(F.broadcast(copies) if few else copies, "tkey", "left").select("t", (1.0 / F.coalesce("copies", F.lit(1))).alias("weight"))


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(kind, a, b, n) over all (t, weight) texts: ``w`` words, ``p`` pairs, ``c`` compounds written in
    a line, ``j`` words that broken or spaced-out ones would give, ``s`` and ``k`` shapes of lone lines
    and those of them that interrupt a sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        pairs: Counter = Counter()
        rest: Counter = Counter()

        def out() -> pa.RecordBatch:
            kinds = ["w"] * len(words) + ["p"] * len(pairs) + [k for k, _, _ in rest]
            a = [*words, *(x for x, _ in pairs), *(x for _, x, _ in rest)]
            b = [""] * len(words) + [y for _, y in pairs] + [y for _, _, y in rest]
            n = [*words.values(), *pairs.values(), *rest.values()]
            words.clear(), pairs.clear(), rest.clear()
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.float64())], names=["kind", "a", "b", "n"])

        for batch in batches:
            for t, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low = lowered(t)
                for _, _, shape, stops in lone_lines(t):
                    rest["s", shape, ""] += weight
                    if stops:  # told apart by text, so that copies of one text are no witnesses
                        rest["k", shape, format(xxhash.xxh32_intdigest(t) % 64)] += weight
                for m in spaced_words(low):
                    for word in _unspaced(m.group()):
                        rest["j", word, ""] += weight
                if broken := broken_words(low):  # their pieces are no words
                    parts, at = [], 0
                    for start, end, left, _, _, right in broken:
                        rest["j", left + right, ""] += weight
                        parts.append(low[at:start])
                        at = max(at, end)
                    low = " ".join([*parts, low[at:]])
                if "-" in low:
                    for m in _HYPHEN.finditer(low):
                        rest["c", low[_letters_before(low, m.start()) : m.start()], m.group(1)] += weight
                found = [_normal[w] for w in words_of(low)]
                held, beside = set(found), set(zip(found, found[1:]))  # texts that hold it: one long text is one witness
                if weight == 1.0:
                    words.update(held)
                    pairs.update(beside)
                else:
                    for w in held:
                        words[w] += weight
                    for w in beside:
                        pairs[w] += weight
                if len(words) + len(pairs) + len(rest) > _HELD:
                    yield out()
        yield out()

    return texts.mapInArrow(run, "kind string, a string, b string, n double").groupBy("kind", "a", "b").agg(F.round(F.sum("n"), 6).alias("n"))


def _unspaced(spaced: str) -> list[str]:
    """The words that spaced-out letters may give, best first; an article may stand beside them."""
    letters = re.sub(r"\s", "", spaced)
    out = [letters]
    if letters[-1] in "aA":
        out.append(letters[:-1])
    if letters[0] in "aAI":
        out.append(letters[1:])
    return out


# --- the channel -------------------------------------------------------------------------------


def vocabulary(counts: DataFrame) -> DataFrame:
    """(word, n): counted words, and words that broken ones would give (0 if never met whole)."""
    return counts.where("kind in ('w', 'j')").groupBy(F.col("a").alias("word")).agg(F.sum(F.when(F.col("kind") == "w", F.col("n")).otherwise(0.0)).alias("n"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, true, n_true, ops): rare words and far more frequent ones of the same strokes."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = [], []
            for i, w in enumerate(b.column(0).to_pylist()):
                for k in stroke_keys(w):
                    keys.append(k)
                    rows.append(i)
            took = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), took.column(0), took.column(1)], names=["key", "word", "n"])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ops = [align(w, t) for w, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            rows = [i for i, o in enumerate(ops) if o]
            took = b.take(pa.array(rows, pa.int64()))
            said = pa.array([[f"{s}>{t}" for s, t in ops[i]] for i in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*took.columns, said], names=[*took.schema.names, "ops"])

    forms = words.mapInArrow(keyed, "key string, word string, n double")
    often = forms.where("n > 0").select("key", F.col("word").alias("true"), F.col("n").alias("n_true"))
    both = forms.join(often, (forms.key == often.key) & (often.n_true > RARER * forms.n) & (often.true != forms.word)).select("word", "n", "true", "n_true")
    return both.distinct().mapInArrow(aligned, "word string, n double, true string, n_true double, ops array<string>")


def confusion_costs(near: DataFrame, words: DataFrame) -> dict[tuple[str, str], float]:
    """-log P(seen group | true group), from all pairs: a rare word counts in parts for its candidates."""
    w = Window.partitionBy("word")
    parts = near.withColumn("part", F.greatest("n", F.lit(1)) * F.col("n_true") / F.sum("n_true").over(w))
    used = {tuple(r["op"].split(">", 1)): r["n"] for r in parts.select(F.explode("ops").alias("op"), "part").groupBy("op").agg(F.sum("part").alias("n")).collect()}  # a finite set
    groups = sorted({t for _, t in used})

    def exposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i in range(len(word)):
                    for k in range(1, GROUP + 1):
                        total[word[i : i + k]] += n
                if len(total) > _HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.float64())], names=["g", "n"])
                    total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.float64())], names=["g", "n"])

    seen = words.where("n > 0").select("word", "n").mapInArrow(exposed, "g string, n double").where(F.col("g").isin(groups) if groups else F.lit(False))
    exposure = {r["g"]: r["n"] for r in seen.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    return {(s, t): -math.log(min(0.5, (n + 0.5) / (exposure.get(t, 0) + 1.0))) for (s, t), n in used.items()}


def candidates(near: DataFrame, costs: dict[tuple[str, str], float]) -> DataFrame:
    """(word, n, found: array of (true, n_true, cost)): every candidate a word's own count does not outweigh."""

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            price = [channel_cost([tuple(o.split(">", 1)) for o in ops], costs) for ops in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(price, pa.float64())], names=["word", "n", "true", "n_true", "cost"])

    all_ = near.mapInArrow(priced, "word string, n double, true string, n_true double, cost double")
    own = F.greatest(F.col("n") - 1, F.lit(UNSEEN))
    kept = all_.where(F.log(F.col("n_true") / own) >= F.col("cost") - PAGE_GAIN)
    return kept.groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("cost", "true", "n_true"))).alias("found"))


def suspect_bitmap(suspects: DataFrame) -> bytes:
    """A bitmap of fixed size in which every suspect's hash is set."""
    place = F.pmod(F.xxhash64("word"), F.lit(BITMAP_BITS)) + 1  # Spark counts bits from 1
    rows = suspects.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = bytearray(BITMAP_BITS // 8)
    for r in rows.collect():  # at most BITMAP_BITS / 32,768 rows of 4 KB
        at = (r["bucket"] - 1) * 4096
        out[at : at + len(r["bits"])] = bytes(r["bits"])
    return bytes(out)


def _in_bitmap(bitmap: bytes, word: str) -> bool:
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=42)
    h = (h - (1 << 64) if h >> 63 else h) % BITMAP_BITS
    return bool(bitmap[h // 8] >> (h % 8) & 1)


# --- events ------------------------------------------------------------------------------------

_EVENT = "tkey string, kind string, s int, e int, x string, y string, mark string, starts array<int>, ends array<int>"


def text_events(text: str, is_suspect) -> list[tuple]:
    """(kind, start, end, x, y, mark, starts, ends) of everything in a text that may be a trace:
    ``line`` (x its shape), ``page`` (form feed), ``broken`` (x the joined word, y its parts, mark the
    sign), ``spaced`` (x a word it may give, y its rank), ``run`` (x the words with one neighbour on
    each side, starts and ends of the suspects)."""
    out: list[tuple] = []
    low = lowered(text)
    for s, e, shape, _ in lone_lines(text):
        out.append(("line", s, e, shape, "", "", None, None))
    at = text.find("\f")
    while at >= 0:
        out.append(("page", at, at + 1, "", "", "", None, None))
        at = text.find("\f", at + 1)
    covered: list[tuple[int, int]] = []
    for m in spaced_words(text):
        covered.append(m.span())
        for rank, word in enumerate(_unspaced(m.group())):
            out.append(("spaced", m.start(), m.end(), word.lower(), str(rank), "", None, None))
    if "\n" in text:
        for start, end, left, mark, between, right in broken_words(text):
            if right[0].islower() or (left.isupper() and right.isupper()):
                covered.append((start, end))
                x = (left + right).lower()
                out.append(("broken", start, end, x, f"{left.lower()} {right.lower()}", ("lines " if between.strip() else "") + mark, None, None))
    words = words_of(low)
    if any(map(is_suspect, set(words))):
        spans = [m.span() for m in _WORD.finditer(low)]
        normal = [_normal[w] for w in words]
        covered.sort()
        c = 0
        doubtful = []
        for (s, e), w in zip(spans, words):
            while c < len(covered) and covered[c][1] <= s:
                c += 1
            inside = c < len(covered) and covered[c][0] < e
            doubtful.append(not inside and len(w) > 1 and is_suspect(w) and _whole(text, s, e))
        i = 0
        while i < len(words):
            if not doubtful[i]:
                i += 1
                continue
            k = i
            while k + 1 < len(words) and doubtful[k + 1]:
                k += 1
            run = [normal[i - 1] if i else "", *normal[i : k + 1], normal[k + 1] if k + 1 < len(words) else ""]
            out.append(("run", spans[i][0], spans[k][1], " ".join(run), "", "", [s for s, _ in spans[i : k + 1]], [e for _, e in spans[i : k + 1]]))
            i = k + 1
    return out


def _whole(text: str, start: int, end: int) -> bool:
    around = (text[start - 1] if start else " ") + (text[end] if end < len(text) else " ")
    return all(c.isascii() or c in _SOUND for c in around)


def find_events(keyed: DataFrame, bitmap: bytes) -> DataFrame:
    """Events of (tkey, text) rows."""
    shared = keyed.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        class Known(dict):
            def __missing__(self, word: str) -> bool:
                if len(self) > _REMEMBERED:
                    self.clear()
                self[word] = found = _in_bitmap(bits, _normal[word])
                return found

        is_suspect = Known().__getitem__
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = ["tkey", "kind", "s", "e", "x", "y", "mark", "starts", "ends"]
        for b in batches:
            rows = [(k, *e) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for e in text_events(t, is_suspect)]
            cols = list(zip(*rows)) or [()] * len(names)
            for lo in range(0, max(len(rows), 1), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 50_000], t) for c, t in zip(cols, types)], names=names)

    return keyed.mapInArrow(run, _EVENT)


# --- decoding ----------------------------------------------------------------------------------


def viterbi(tokens: list[str], lattice: list[list[tuple[str, float, float]]], pairs: dict[tuple[str, str], float], total: float) -> list[str]:
    """The likeliest words of a run.  ``tokens`` has one fixed neighbour on each side; the lattice
    holds (word, count, channel cost) for each token between, itself first."""

    def step(left: tuple, right: tuple, fixed: bool) -> float:
        n = pairs.get((left[0], right[0]), 0.0) - (right[2] == 0.0 and not fixed)  # not its own witness
        return -math.log((max(n, 0.0) + BACKOFF * max(right[1], UNSEEN) / total) / (max(left[1], 0.0) + BACKOFF))

    first, last = (tokens[0], 0.0, 0.0), (tokens[-1], 1.0, 0.0)
    scores, back, previous = [0.0], [], [first]
    for k, options in enumerate([*lattice, [last]]):
        fixed = k == len(lattice)
        row, links = [], []
        for o in options:
            if not o[0]:  # the text begins or ends here
                best, i = min((s, i) for i, s in enumerate(scores))
            else:
                best, i = min((s + step(p, o, fixed), i) for i, (s, p) in enumerate(zip(scores, previous)))
            row.append(best + (o[2] - PAGE_GAIN if o[2] else 0.0))
            links.append(i)
        scores, previous = row, options
        back.append(links)
    at, out = 0, []
    for k in range(len(lattice), 0, -1):
        at = back[k][at]
        out.append(lattice[k - 1][at][0])
    return out[::-1]


def _options(run: str, found: list) -> tuple[list[str], list[list[tuple[str, float, float]]]]:
    tokens = run.split(" ")
    lattice = [[(t, UNSEEN, 0.0)] for t in tokens[1:-1]]
    for f in found:
        own = max(float(f["n"]) - 1, UNSEEN)
        lattice[f["at"]] = [(tokens[f["at"] + 1], own, 0.0)] + [(c["true"], float(c["n_true"]), max(c["cost"], 1e-9)) for c in f["found"]]
    return tokens, lattice


def decode_runs(runs: DataFrame, suspects: DataFrame, counts: DataFrame, total: float) -> DataFrame:
    """(run, words) of the distinct runs that change: candidates joined, then pair counts, then Viterbi."""
    each = runs.select(F.col("x").alias("run")).distinct()
    tokens = F.split("run", " ")
    inner = each.select("run", F.posexplode(F.slice(tokens, 2, F.size(tokens) - 2)).alias("at", "word"))
    lattices = inner.join(suspects, "word").groupBy("run").agg(F.collect_list(F.struct("at", "n", "found")).alias("found"))  # as long as the run
    ensure_checkpoint_dir(runs.sparkSession)
    lattices = lattices.checkpoint()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs_, left, right = [], [], []
            for run, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words, lattice = _options(run, found)
                rows = [[(words[0], 0, 0)], *lattice, [(words[-1], 0, 0)]]
                for p, q in {(p[0], q[0]) for ps, qs in zip(rows, rows[1:]) for p in ps for q in qs if p[0] and q[0]}:
                    runs_.append(run), left.append(p), right.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(runs_, pa.string()), pa.array(left, pa.string()), pa.array(right, pa.string())], names=["run", "a", "b"])

    known = counts.where("kind = 'p'").select("a", "b", "n")
    pairs = lattices.mapInArrow(asked, "run string, a string, b string").join(known, ["a", "b"]).groupBy("run").agg(F.collect_list(F.struct("a", "b", "n")).alias("pairs"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs_, words = [], []
            for run, found, pair in zip(*(b.column(i).to_pylist() for i in range(3))):
                seen, lattice = _options(run, found)
                best = viterbi(seen, lattice, {(p["a"], p["b"]): float(p["n"]) for p in pair or []}, total)
                if best != seen[1:-1]:
                    runs_.append(run)
                    words.append(best)
            yield pa.RecordBatch.from_arrays([pa.array(runs_, pa.string()), pa.array(words, pa.list_(pa.string()))], names=["run", "words"])

    return lattices.join(pairs, "run", "left").select("run", "found", "pairs").mapInArrow(decoded, "run string, words array<string>")


# --- edits -------------------------------------------------------------------------------------


def find_edits(texts: DataFrame) -> DataFrame:
    """(tkey, kind, s, e, new, alone) for the texts (column ``t``), keyed by their digest: what to
    replace by what; ``alone`` is false for words broken across lines that may be furniture."""
    spark = texts.sparkSession
    ensure_checkpoint_dir(spark)
    texts = texts.where("t is not null and t <> ''")
    keyed = texts.select(F.md5("t").alias("tkey"), "t")
    counts = corpus_counts(weighted(keyed)).checkpoint()
    words = vocabulary(counts)
    near = near_words(words).checkpoint()
    suspects = candidates(near, confusion_costs(near, words)).checkpoint()
    total = float(counts.where("kind = 'w'").agg(F.sum("n")).first()[0] or 1)
    events = find_events(keyed, suspect_bitmap(suspects)).checkpoint()

    shapes = counts.where("kind in ('s', 'k')").groupBy(F.col("a").alias("x")).agg(
        F.sum(F.when(F.col("kind") == "s", F.col("n")).otherwise(0)).alias("lines"), F.sum(F.when(F.col("kind") == "k", F.col("n")).otherwise(0)).alias("stops"),
        F.count_if(F.col("kind") == "k").alias("texts"),
    )
    furniture_shapes = shapes.where((F.col("texts") >= LEAST_TEXTS) & (F.col("stops") >= LEAST_INTERRUPTING * F.col("lines"))).select("x")
    lines = events.where("kind = 'line'").join(furniture_shapes, "x", "left_semi")
    lines = lines.select("tkey", F.lit("furniture").alias("kind"), "s", "e", F.lit("").alias("new"), F.lit(True).alias("alone"))
    pages = events.where("kind = 'page'").select("tkey", F.lit("furniture").alias("kind"), "s", "e", F.lit("\n").alias("new"), F.lit(True).alias("alone"))

    # words that broken or spaced-out ones would give, with what is known of them and of their parts
    asked = events.where("kind in ('broken', 'spaced')")
    parts = asked.where("kind = 'broken'").select("x", "y").distinct()
    parts = parts.select("x", "y", F.split("y", " ")[0].alias("l"), F.split("y", " ")[1].alias("r"))
    whole = words.where("n > 0").select(F.col("word"), F.col("n"))
    first = suspects.select(F.col("word").alias("x"), F.col("found")[0]["true"].alias("as"), F.col("found")[0]["n_true"].alias("n_as"), F.col("n").alias("n_x"))
    joined = asked.select("x").distinct().join(whole.withColumnRenamed("word", "x"), "x", "left").join(first, "x", "left")
    joined = joined.select("x", F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("n_as", F.lit(0.0)).alias("n_as"), "as")
    compound = counts.where("kind = 'c'").select(F.col("a").alias("l"), F.col("b").alias("r"), F.col("n").alias("compound"))
    judged = (
        parts.join(compound, ["l", "r"], "left")
        .join(whole.select(F.col("word").alias("l"), F.col("n").alias("n_l")), "l", "left")
        .join(whole.select(F.col("word").alias("r"), F.col("n").alias("n_r")), "r", "left")
        .select("x", "y", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("compound", "n_l", "n_r")], F.length("r").alias("len_r"))
    )
    sign = F.regexp_replace("mark", "^lines ", "")
    best = F.greatest("n", "n_as")
    broken = asked.where("kind = 'broken'").join(judged, ["x", "y"]).join(joined, "x")
    real = (
        F.when(sign.isin(*SOFT), F.lit(True))
        .when(sign != "-", (best > 0) & ((F.length(sign) > 1) | (F.ascii(sign) > 127) | (sign == "?")))
        .when(best > 0, best > F.col("compound"))
        .otherwise((F.col("compound") == 0) & ~((F.col("n_l") > 0) & (F.col("n_r") > 0)) & (F.col("len_r") > 1))
    )
    new = F.when((F.col("n") == 0) & F.col("as").isNotNull(), F.col("as")).otherwise(F.col("x"))
    broken = broken.where(real).select("tkey", F.lit("broken").alias("kind"), "s", "e", new.alias("new"), (~F.col("mark").startswith("lines ")).alias("alone"))
    spaced = asked.where("kind = 'spaced'").join(joined, "x").where((best > 0) | ((F.col("y") == "0") & (F.length("x") >= 5)))
    rank = F.when(best > 0, F.col("y").cast("int")).otherwise(9)
    spaced = spaced.groupBy("tkey", "s", "e").agg(F.min_by("x", rank).alias("new"))
    spaced = spaced.select("tkey", F.lit("spaced").alias("kind"), "s", "e", "new", F.lit(True).alias("alone"))

    runs = events.where("kind = 'run'")
    decoded = decode_runs(runs, suspects, counts, total)
    read = runs.select("tkey", F.col("x").alias("run"), "starts", "ends").join(decoded, "run")
    tokens = F.split("run", " ")
    each = read.select("tkey", F.posexplode(F.arrays_zip("starts", "ends", "words", F.slice(tokens, 2, F.size(tokens) - 2).alias("seen"))).alias("i", "z"))
    misread = each.where("z.words <> z.seen").select(
        "tkey", F.lit("misread").alias("kind"), F.col("z.starts").alias("s"), F.col("z.ends").alias("e"), F.col("z.words").alias("new"), F.lit(True).alias("alone")
    )
    return lines.unionByName(pages).unionByName(broken).unionByName(spaced).unionByName(misread)


def _like(seen: str, word: str) -> str:
    """A corrected word in the case of what was read; masked digits are read off the letters."""
    if "#" in word:
        return "".join(LIKE_DIGITS.get(s.lower(), s) if w == "#" and not s.isdigit() else s for s, w in zip(seen, word))
    if (seen.isupper() and len(seen) > 1) or sum(c.isupper() for c in seen) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if seen[:1].isupper() or (seen[:1] in "l1" and word[:1] == "i" and False) else word


def _joined_like(seen: str, word: str) -> str:
    letters = "".join(c for c in seen if c.isalpha())
    return word if len(letters) != len(word) and not letters[:1].isupper() else letters if letters.lower() == word else _like(letters, word)


def apply_edits(text: str, edits: list[tuple[int, int, str, str, bool]]) -> tuple[str, Counter]:
    """The repaired text, and how many traces of each kind were taken out."""
    kinds: Counter = Counter()
    gone = sorted((s, e) for s, e, _, kind, _ in edits if kind == "furniture")
    chosen: list[tuple[int, int, str, str]] = []
    for s, e, new, kind, alone in sorted(set(edits), key=lambda x: (x[3] != "broken", x[0], -x[1])):
        if kind == "broken":
            if not alone:
                between = text[text.index("\n", s) : e]
                at, inside = text.index("\n", s), [x for x in gone[bisect_left(gone, (s, 0)) : bisect_left(gone, (e, 0))] if x[1] < e]
                left = "".join(c for i, c in enumerate(between, at) if not any(a <= i < b for a, b in inside))
                if len(re.findall(r"\S+", left)) != 1:  # text stands between
                    continue
            piece = _joined_like(re.sub(r"[^\n]*\n(?:[^\n]*\n)*", lambda m: m.group().split("\n")[0].rstrip(), text[s:e]), new)
        elif kind == "spaced":
            piece = _spaced_like(text[s:e], new)
        elif kind == "misread":
            piece = _like(text[s:e], new)
        else:
            piece = new
        chosen.append((s, e, piece, kind))
    parts, at = [], 0
    for s, e, piece, kind in sorted(chosen, key=lambda x: (x[0], -x[1])):
        kinds[kind] += 1
        if s < at:  # furniture inside a broken word that is already joined
            continue
        parts += [text[at:s], piece]
        at = e
    out = "".join(parts) + text[at:]
    if kinds["furniture"]:
        out = re.sub(r"\n[ \t]*(?:\n[ \t]*)+(?=[a-z(§$\d])", "\n", out)
    return out, kinds


def _spaced_like(seen: str, word: str) -> str:
    letters = re.sub(r"\s", "", seen)
    if letters.lower() == word:
        return letters
    if letters.lower().startswith(word):
        return f"{letters[: len(word)]} {letters[len(word) :]}"
    return f"{letters[: -len(word)]} {letters[-len(word) :]}" if letters.lower().endswith(word) else _like(letters, word)


_HEADING = re.compile(r"[A-Z0-9][A-Z0-9 '’.,&()/-]{2,70}")
_LIST_ITEM = re.compile(r"\s*(?:\d{1,3}[.)]|\([\da-z]{1,3}\)|[-•*]\s|\d{1,6}\s*$)")


def reflow(lines: list[str]) -> str:
    """Joins hard-wrapped lines to paragraphs: a line goes on in the next one unless a blank line, a
    heading or a list item is between, or it ends a sentence well before the usual width."""
    full = sorted(len(x) for x in lines if len(x) > 30)
    width = full[int(len(full) * 0.8)] if full else 0
    out: list[str] = []
    open_ = False
    for i, x in enumerate(lines):
        s = x.strip()
        if not s:
            open_ = False
            continue
        heading = bool(_HEADING.fullmatch(s)) or s.startswith(("Re: ", "Dated ", "TAA "))
        if open_ and not heading and not _LIST_ITEM.match(x):
            out[-1] += " " + s
        else:
            out.append(s)
        first = lines[i + 1].split(" ", 1)[0] if i + 1 < len(lines) else ""
        short = len(x.rstrip()) + 1 + len(first) < width
        ended = s[-1] in ".!?:”" and (short or width > 200)
        open_ = not heading and not ended and not (_LIST_ITEM.match(x) and short)
    return "\n".join(out)


def find_scans(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of the rows whose text bears traces of a page scan."""
    source = documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__t"))
    traces = find_edits(source.select(F.col("__t").alias("t"))).where("alone").select("tkey").distinct()
    return source.withColumn("__key", F.md5("__t")).join(traces, F.col("__key") == traces.tkey, "left_semi").select(*keep)


def repair_scans(documents: DataFrame, keep: list[str], text: str = "text", only_found: bool = True) -> DataFrame:
    """``keep`` columns, counts of each kind of trace, and the repaired text; only scans, or all
    rows (then those that are no scans keep their text as it is)."""
    extra = [StructField(n, IntegerType()) for n in ("n_furniture", "n_broken", "n_spaced", "n_misread")]
    extra += [StructField("scanned", BooleanType()), StructField("repaired_text", StringType())]
    names = [c for c in keep if c not in {f.name for f in extra}]
    schema = StructType([documents.schema[c] for c in names] + extra)
    source = documents.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__t"))
    edits = find_edits(source.select(F.col("__t").alias("t"))).groupBy("tkey").agg(F.collect_set(F.struct("s", "e", "new", "kind", "alone")).alias("__edits"))  # of one text
    both = source.withColumn("tkey", F.md5("__t")).join(edits, "tkey", "inner" if only_found else "left").select(*names, "__t", "__edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32()] * 4 + [pa.bool_(), pa.string()]
        for b in batches:
            rows, cols = [], [[] for _ in extra]
            for r, (t, e) in enumerate(zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist())):
                repaired, kinds = apply_edits(t, [(x["s"], x["e"], x["new"], x["kind"], x["alone"]) for x in e]) if e else (t, Counter())
                if only_found and not kinds:
                    continue
                rows.append(r)
                values = [kinds[k] for k in ("furniture", "broken", "spaced", "misread")] + [bool(kinds), reflow(repaired.split("\n")) if kinds else t]
                for c, v in zip(cols, values):
                    c.append(v)
            kept = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(i) for i in range(len(names))] + [pa.array(c, t) for c, t in zip(cols, types)], names=schema.names)

    return both.mapInArrow(run, schema)
