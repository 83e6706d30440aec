"""Splitting oversized items at natural boundaries.

Dynamic programming over boundary positions: the cut positions of an item are those that minimise
the sum of cut penalties and of the pieces' squared deviation from equal size, subject to the
maximum length, where each piece after the first begins ``overlap`` units before the cut.  Finer
kinds of boundary are laid out only where coarser ones are more than half a piece apart: a word cut
costs 4 more than a sentence's, which no gain in balance (at most ``BALANCE`` for either piece) pays.

Lengths are Unicode code points (or tokens in :func:`split_by_tokens`).  Defined edge cases: null,
empty and fitting texts give no piece; without any natural boundary in reach a text is cut anywhere
except inside a CR LF pair or before a combining mark; the pieces without their overlaps join to
the exact text; repeated rows give repeated pieces; other columns are carried by name, and
a column named like an output column is left out.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from statloom.llm.tokens import VOCABULARY, counter

#: Kinds of boundary, best first, with the penalty of a cut there.
PENALTIES = {"subsection": 0.0, "paragraph": 0.4, "sentence": 1.0, "clause": 3.0, "line": 3.5, "word": 5.0, "none": 12.0}
#: Weight of a piece's squared relative deviation from equal size.
BALANCE = 2.0

_MARKER = regex.compile(r"(?:\r\n|\n|\r)[ \t]*(?=\((?:\d{1,3}|[A-Za-z]{1,4})\)|(?:SECTION|Section|§)\s*\d|\d{1,3}\.[ \t]|[A-Z][A-Z’' \t&-]{3,60}(?:[\r\n]|$))")
_BLANK_LINE = regex.compile(r"(?:\r\n|\n|\r)[ \t]*(?:(?:\r\n|\n|\r)[ \t]*)+")
_LINE, _LINES = regex.compile(r"\r\n|\n|\r"), regex.compile(r"(?:\r\n|\n|\r)+")
_SENTENCE = regex.compile(r"(?<!\b(?:s|ss|v|vs|No|Inc|Corp|Co|Stat|Fla|ch|art|Mr|Mrs|Dr|St|F|A|C|S|U|p|pp)\.)(?<=[.!?。！？][\"”’»)\]]{0,3})\s+(?=[\"“‘«(\[§¿¡]*[\p{Lu}\p{Lo}\d])")
_CLAUSE = regex.compile(r"(?<=[;:—,])\s+")
_WORD = regex.compile(r"\s+")


def _coarse(text: str) -> dict[int, str]:
    """Positions after which a new subsection, paragraph or sentence begins."""
    kind: dict[int, str] = {}
    for m in _SENTENCE.finditer(text):
        kind[m.end()] = "sentence"
    for m in _LINE.finditer(text):
        before = text[max(0, m.start() - 3) : m.start()].rstrip()
        if before[-1:] in tuple(".!?:;") or kind.get(m.end()) == "sentence":
            kind[m.end()] = "paragraph"
    for m in _BLANK_LINE.finditer(text):
        kind[m.end()] = "paragraph"
    for m in _MARKER.finditer(text):
        kind[m.end()] = "subsection"
    return kind


def _fill(text: str, kind: dict[int, str], reach: int) -> dict[int, str]:
    """Adds finer boundaries where neighbouring ones are more than ``reach`` apart."""
    for name, pattern in (("clause", _CLAUSE), ("line", _LINES), ("word", _WORD)):
        at = [0, *sorted(kind), len(text)]
        for lo, hi in zip(at, at[1:]):
            if hi - lo > reach:
                for m in pattern.finditer(text, lo, hi):
                    if lo < m.end() < hi:
                        kind.setdefault(m.end(), name)
    at = [0, *sorted(kind), len(text)]
    for lo, hi in zip(at, at[1:]):
        if hi - lo > reach:
            step = max(1, reach // 8)
            for p in range(lo + step, hi, step):
                while p > lo + 1 and (unicodedata.combining(text[p]) or text[p] in "‍️" or text[p - 1 : p + 1] == "\r\n"):
                    p -= 1
                kind.setdefault(p, "none")
    return kind


def _best(at: list[int], penalty: list[float], size: list[float], limit: float, overlap: float) -> list[int] | None:
    """Indices of the chosen cuts among positions ``at`` (0 first, the end last) by dynamic
    programming; ``size`` is the running size at each position.  None if no split fits."""
    n = len(at) - 1
    room = limit - overlap
    total = size[n]
    ideal = total / max(1, -(-(total - overlap) // room))
    cost = [0.0] + [float("inf")] * n
    via = [-1] * (n + 1)
    for j in range(1, n + 1):
        lo = bisect_left(size, size[j] - limit, 0, j)
        best, which = float("inf"), -1
        for i in range(lo, j):
            length = size[j] - size[i] + (overlap if i else 0)
            if length <= limit and cost[i] < best:
                c = cost[i] + BALANCE * ((length - ideal) / limit) ** 2
                if c < best:
                    best, which = c, i
        cost[j], via[j] = best + penalty[j], which
    if cost[n] == float("inf"):
        return None
    cuts, j = [], n
    while j > 0:
        cuts.append(j)
        j = via[j]
    return cuts[::-1]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the boundary at the end) of each piece of one text."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    if len(text) <= limit:
        return [(0, len(text), "end")]
    room = limit - overlap
    kind = _fill(text, {p: k for p, k in _coarse(text).items() if overlap < p < len(text)}, max(1, room // 2))
    while True:
        inner = sorted(p for p in kind if overlap < p < len(text))
        at = [0, *inner, len(text)]
        cuts = _best(at, [0.0, *(PENALTIES[kind[p]] for p in inner), 0.0], at, limit, overlap)
        if cuts is not None:
            break
        for p in range(overlap + 1, len(text), max(1, room // 16)):
            kind.setdefault(p, "none")
        if len(inner) + 2 == len({0, *kind, len(text)}):
            kind.update({p: kind.get(p, "none") for p in range(overlap + 1, len(text))})
    out, start = [], 0
    for j in cuts:
        end = at[j]
        out.append((start, end, kind.get(end, "none") if end < len(text) else "end"))
        start = end - overlap
    return out


def _heads(c, piece: str, n: int, most: int) -> list[tuple[str, int]]:
    """A piece cut at character positions into heads of at most ``most`` tokens each (each counted
    anew, and cut again where its letters have more tokens than those around them)."""
    k = min(max(1, len(piece) * most // (2 * n)), len(piece) // 2)
    heads = [piece[i : i + k] for i in range(0, len(piece), k)]
    ns = c.trie.counts({h.encode("utf-8", "surrogatepass") for h in heads})
    out: list[tuple[str, int]] = []
    for h in heads:
        m = ns[h.encode("utf-8", "surrogatepass")]
        out += [(h, m)] if m <= most or len(h) < 2 else _heads(c, h, m, most)
    return out


def split_text_tokens(text: str, limit: int, overlap: int, path: str = VOCABULARY) -> list[tuple[int, int, str, int]]:
    """As :func:`split_text` with sizes in tokens: cuts fall between the tokenizer's pieces, and an
    overlap is the shortest run of whole pieces with at least ``overlap`` tokens.  A single piece
    above the limit is cut inside at character positions (each counted anew)."""
    c = counter(path)
    found, counts = c.pieces(text)
    if sum(counts) <= limit:
        return [(0, len(text), "end", sum(counts))]
    # a piece that is itself too long becomes several
    parts: list[tuple[str, int]] = []
    most = max(1, (limit - overlap) // 4)
    for p, n in zip(found, counts):
        if n <= most or len(p) < 2:
            parts.append((p, n))
            continue
        parts += _heads(c, p, n, most)
    return _cut_tokens(text, parts, limit, overlap, c, 0)


def _cut_tokens(text: str, parts: list[tuple[str, int]], aim: int, overlap: int, c, margin: int) -> list[tuple[int, int, str, int]]:
    limit = aim - margin
    offset, size = [0], [0]
    for p, n in parts:
        offset.append(offset[-1] + len(p))
        size.append(size[-1] + n)
    index = {o: k for k, o in enumerate(offset)}
    # the overlap grows to whole pieces, by at most one piece: keep room for that
    slack = max(n for _, n in parts) - 1
    kind: dict[int, str] = {}
    for p, k in _coarse(text).items():
        while p > 0 and p not in index:  # blanks before a word belong to its piece
            p -= 1
        if 0 < p < len(text):
            kind.setdefault(p, k)
    inner = sorted(kind)
    at = [0, *inner, len(text)]
    reach = (limit - overlap - slack) // 2
    for lo, hi in zip(at, at[1:]):
        if size[index[hi]] - size[index[lo]] > reach:
            for k in range(index[lo] + 1, index[hi]):
                kind.setdefault(offset[k], "word")
    inner = sorted(p for p in kind if size[index[p]] > overlap + slack)
    at = [0, *inner, len(text)]
    sizes = [size[index[p]] for p in at]
    cuts = _best(at, [0.0, *(PENALTIES[kind[p]] for p in inner), 0.0], sizes, limit, overlap + slack)
    if cuts is None:
        kind.update({o: kind.get(o, "word") for o in offset[1:-1]})
        inner = sorted(p for p in kind if size[index[p]] > overlap + slack)
        at = [0, *inner, len(text)]
        sizes = [size[index[p]] for p in at]
        cuts = _best(at, [0.0, *(PENALTIES[kind[p]] for p in inner), 0.0], sizes, limit, overlap + slack)
    if cuts is None:
        raise ValueError(f"no split of a text of {sum(n for _, n in parts)} tokens into pieces of {aim} with an overlap of {overlap}")
    out, start = [], 0
    for j in cuts:
        end = at[j]
        out.append((start, end, kind.get(end, "word") if end < len(text) else "end"))
        k = index[end]
        while k > 0 and size[index[end]] - size[k] < overlap:
            k -= 1
        while k > 0 and k < index[end] and c.count([text[offset[k] : end]])[0] < overlap:  # cut off, a run may have fewer tokens
            k -= 1
        start = offset[k]
    true = c.count([text[s:e] for s, e, _ in out])
    over = max(true) - aim
    if over > 0:  # cut off, a piece may have more tokens than within the text: aim lower
        return _cut_tokens(text, parts, aim, overlap, c, margin + over)
    return [(s, e, k, n) for (s, e, k), n in zip(out, true)]


_PIECE = [
    StructField("piece", IntegerType()), StructField("n_pieces", IntegerType()), StructField("start", IntegerType()),
    StructField("end", IntegerType()), StructField("cut", StringType()), StructField("size", IntegerType()), StructField("piece_text", StringType()),
]


def split_oversized(items: DataFrame, limit: int, overlap: int, keep: list[str], text: str = "text", unit: str = "characters", path: str = VOCABULARY) -> DataFrame:
    """One row per piece of each item above the limit: ``keep`` columns, then piece number (from 0),
    number of pieces, start, end, kind of boundary at its end, size in the unit, and its text."""
    if unit not in ("characters", "tokens"):
        raise ValueError("unit is characters or tokens")
    names = [c for c in keep if c not in {f.name for f in _PIECE}]
    schema = StructType([items.schema[c] for c in names] + _PIECE)
    source = items.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__text")).where(
        F.length("__text") > limit if unit == "characters" else F.octet_length("__text") > limit
    )  # a text has at most as many byte-level tokens as bytes
    carried = [source.schema[c] for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            cols: list[list] = [[] for _ in _PIECE]
            held = 0

            def out() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                kept = [b.column(i).take(at) for i in range(len(carried))]
                types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
                return pa.RecordBatch.from_arrays(kept + [pa.array(c, t) for c, t in zip(cols, types)], names=schema.names)

            for r, t in enumerate(b.column(len(carried)).to_pylist()):
                if unit == "characters":
                    found = [(s, e, k, e - s) for s, e, k in split_text(t, limit, overlap)]
                else:
                    found = split_text_tokens(t, limit, overlap, path)
                    if len(found) < 2:
                        continue
                for n, (s, e, k, size) in enumerate(found):
                    rows.append(r)
                    for col, v in zip(cols, (n, len(found), s, e, k, size, t[s:e])):
                        col.append(v)
                held += len(t)
                if held > 8_000_000:
                    yield out()
                    held = 0
                    rows.clear()
                    for col in cols:
                        col.clear()
            if rows:
                yield out()

    return source.mapInArrow(run, schema)


def size_limit(limits: DataFrame, name: str) -> tuple[int, int]:
    """(capacity, overlap) of a named limit; the limits are a fixed table of a few rows."""
    row = limits.where(F.col("limit_name") == name).select("capacity", "overlap").first()
    if row is None:
        raise ValueError(f"no limit named {name}")
    return int(row["capacity"]), int(row["overlap"] or 0)
