"""Exact token counts without running the tokenizer over every text.

A byte-level BPE tokenizer cuts a text into pieces by a fixed pattern and encodes each piece by
itself, so a text's count is the sum over its pieces, and a corpus has few distinct pieces.

* :func:`piece_tokens` makes the table of a corpus: the distinct pieces of each partition, made
  distinct over all, are partitioned by their first characters and sorted, which lays out a prefix
  trie in every partition.  The tokenization state (last token, count) is carried along shared
  prefixes: the encoding of a prefix ends in the one suffix token that may follow the encoding of
  what is left before it.  So each trie node is computed once in the whole cluster, in time linear
  in its depth, however long a piece is.
* :func:`with_piece_tokens` joins the counts at the terminals to the documents: looked up in a
  broadcast table where it has at most ``MOST_PIECES`` rows, by a shuffle on the pieces otherwise.
* :func:`with_tokens` is for operators that need the sizes of their rows in one pass over the
  texts: the same trie over the new pieces of each batch, without a shuffle; the state kept between
  batches is bounded (it is emptied when full, which changes no result).

Defined edge cases: null and empty texts have 0 tokens; special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex

#: Path of the vocabulary (ranks of a byte-level BPE); a parameter of every operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that goes with it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most pieces kept between batches, and the longest piece that is kept.
KEPT_PIECES, KEPT_LENGTH = 400_000, 200

#: Frequent function words that tell the four languages apart.
FUNCTION_WORDS = {
    "en": "the of and to is by for that with from are this which shall any be or not on under".split(),
    "es": "el los las del una por para con según cuando está más ejercicio debe sobre al impuesto".split(),
    "pt": "o os da do dos das uma não em ao pela pelo conforme são às até imposto sobre".split(),
    "fr": "le les des une du est pour dans et aux sur par selon pas l’ d’ la société impôt ne".split(),
}
_LANGS, _SHIFT = tuple(FUNCTION_WORDS), 48  # beyond the tokens of any text


class PieceTrie:
    """Token counts of pieces under one vocabulary."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.longest = max(map(len, self.ranks))
        self._follows: dict[tuple[bytes, bytes], bool] = {}

    def _merge(self, data: bytes) -> list[bytes]:
        """Plain BPE of a short string: merge the lowest-ranked neighbours until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, left: bytes, right: bytes) -> bool:
        known = self._follows.get((left, right))
        if known is None:
            if len(self._follows) > KEPT_PIECES:
                self._follows.clear()
            known = self._follows[left, right] = self._merge(left + right) == [left, right]
        return known

    def counts(self, pieces: Iterable[bytes]) -> dict[bytes, int]:
        """Count of each piece: a walk over the trie that the sorted pieces spell out."""
        return dict(self.walk(sorted(pieces)))

    def walk(self, pieces: Iterable[bytes]) -> Iterator[tuple[bytes, int]]:
        """(piece, count) of pieces in byte order: the states of the path to the last one are kept."""
        last: list[bytes] = [b""]  # last token of the encoding of each prefix on the path
        count = [0]
        before = b""
        ranks, longest, may_follow = self.ranks, self.longest, self._may_follow
        for piece in pieces:
            shared, most = 0, min(len(before), len(piece))
            while shared < most and before[shared] == piece[shared]:
                shared += 1
            del last[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(piece) + 1):
                for start in range(max(0, end - longest), end):
                    token = piece[start:end]
                    if token in ranks and (not start or may_follow(last[start], token)):
                        last.append(token)
                        count.append(count[start] + 1)
                        break
            before = piece
            yield piece, count[-1]


    def tokens(self, piece: bytes) -> list[bytes]:
        """The tokens of one piece: the states along its prefixes, read back from its end."""
        last: list[bytes] = [b""]
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                token = piece[start:end]
                if token in self.ranks and (not start or self._may_follow(last[start], token)):
                    last.append(token)
                    break
        out, end = [], len(piece)
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]


class TokenCounter:
    """Counts of texts; also how often each language's function words occur."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        self.trie = PieceTrie(path)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, int] = {}
        self.words = _scores()

    def _packed(self, texts: list[str | None]) -> list[int]:
        """Per text, the token count in the low bits and the language scores above it."""
        pieces = [self.split(t) if t else () for t in texts]
        known = self.known
        new = set().union(*pieces) - known.keys()
        extra: dict[str, int] = {}
        if new:
            raw = {p: p.encode("utf-8", "surrogatepass") for p in new}
            found = self.trie.counts(set(raw.values()))
            if len(known) + len(new) > KEPT_PIECES:
                known.clear()
                return self._packed(texts) if len(new) <= KEPT_PIECES else self._packed_apart(texts)
            for p, b in raw.items():
                (known if len(p) <= KEPT_LENGTH else extra)[p] = found[b] + self.words.get(p, 0)
        if extra:
            both = lambda p: known[p] if p in known else extra[p]
            return [sum(map(both, x)) for x in pieces]
        return [sum(map(known.__getitem__, x)) for x in pieces]

    def _packed_apart(self, texts: list[str | None]) -> list[int]:
        if len(texts) > 1:
            half = len(texts) // 2
            return self._packed(texts[:half]) + self._packed(texts[half:])
        pieces = self.split(texts[0] or "")
        found = self.trie.counts({p.encode("utf-8", "surrogatepass") for p in pieces})
        return [sum(found[p.encode("utf-8", "surrogatepass")] + self.words.get(p, 0) for p in pieces)]

    def count(self, texts: list[str | None]) -> list[int]:
        return [x & ((1 << _SHIFT) - 1) for x in self._packed(texts)]

    def count_and_language(self, texts: list[str | None]) -> tuple[list[int], list[str | None]]:
        """Counts, and the language whose function words lead clearly (else null)."""
        mask = (1 << _SHIFT) - 1
        counts, langs = [], []
        for x in self._packed(texts):
            counts.append(x & mask)
            langs.append(language_of(x))
        return counts, langs

    def truncate(self, text: str | None, most: int) -> str:
        """The beginning of a text that its first ``most`` tokens spell (a character that they spell in
        part is left out)."""
        if not text or most <= 0:
            return ""
        found, counts = self.pieces(text)
        total = at = 0
        for p, n in zip(found, counts):
            if total + n > most:
                parts = self.trie.tokens(p.encode("utf-8", "surrogatepass"))[: most - total]
                return text[:at] + b"".join(parts).decode("utf-8", "ignore")
            total += n
            at += len(p)
        return text

    def pieces(self, text: str) -> tuple[list[str], list[int]]:
        """A text's pieces and the tokens of each."""
        found, known, mask = self.split(text), self.known, (1 << _SHIFT) - 1
        self._packed([text])
        counts = [known.get(p, -1) for p in found]
        if -1 in counts:
            rest = {p: p.encode("utf-8", "surrogatepass") for p, n in zip(found, counts) if n < 0}
            more = self.trie.counts(set(rest.values()))
            counts = [more[rest[p]] if n < 0 else n for p, n in zip(found, counts)]
        return found, [n & mask for n in counts]


def truncated(df, most: int, text: str = "text", path: str = VOCABULARY):
    """``df`` with its texts cut after their first ``most`` tokens; null texts become empty."""
    names = df.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            cut = pa.array([c.truncate(t, most) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([cut if i == at else b.column(i) for i in range(len(names))], names=names)

    return df.mapInArrow(run, df.schema)


#: Most rows of a table of pieces that are broadcast, and characters of its partitions' prefixes.
MOST_PIECES, PREFIX = 1_000_000, 3


def _scores() -> dict[str, int]:
    """Function words of each language as pieces, packed like the counts."""
    out: dict[str, int] = {}
    for k, lang in enumerate(_LANGS):
        for w in FUNCTION_WORDS[lang]:
            for form in (w, f" {w}", w.capitalize(), f" {w.capitalize()}"):
                out[form] = out.get(form, 0) + (1 << _SHIFT * (k + 1))
    return out


def language_of(packed: int) -> str | None:
    """The language whose function words lead clearly (else null)."""
    mask = (1 << _SHIFT) - 1
    scores = sorted(((packed >> _SHIFT * (k + 1)) & mask, lang) for k, lang in enumerate(_LANGS))
    (second, _), (most, lang) = scores[-2:]
    return lang if most >= 3 and most >= 2 * second else None


def piece_tokens(texts, text: str = "text", path: str = VOCABULARY, pattern: str = PATTERN):
    """(piece, tokens) of all distinct pieces of the texts, from prefix tries in every partition."""
    from pyspark.sql import functions as F

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = regex.compile(pattern).findall, set()
        for b in batches:
            for t in b.column(0).to_pylist():
                held.update(split(t))
            if len(held) > KEPT_PIECES:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["piece"])
                held = set()
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["piece"])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PieceTrie(path)
        names, counts = [], []
        for p, n in trie.walk(p.encode("utf-8") for b in batches for p in b.column(0).to_pylist()):
            names.append(p.decode("utf-8"))
            counts.append(n)
            if len(names) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int32())], names=["piece", "tokens"])
                names, counts = [], []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int32())], names=["piece", "tokens"])

    source = texts.select(F.col(f"`{text}`").cast("string").alias("t")).where("t is not null and t <> ''")
    distinct = source.mapInArrow(found, "piece string").distinct()
    return distinct.repartition(F.substring("piece", 1, PREFIX)).sortWithinPartitions("piece").mapInArrow(walked, "piece string, tokens int")


def with_piece_tokens(df, pieces, text: str = "text", keep: list[str] | None = None, pattern: str = PATTERN, most: int | None = None):
    """``df`` with ``text`` replaced by ``tokens`` and ``found_lang``, from a table of pieces that
    covers its texts (written once: it is counted and then read)."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    names = [c for c in (keep if keep is not None else df.columns) if c != text]
    source = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = StructType([source.schema[c] for c in names] + [StructField("tokens", LongType()), StructField("found_lang", StringType())])
    few = pieces.limit((MOST_PIECES if most is None else most) + 1).count() <= (MOST_PIECES if most is None else most)
    if few:
        rows = pieces.toArrow() if hasattr(pieces, "toArrow") else pa.Table.from_pandas(pieces.toPandas())
        shared = df.sparkSession.sparkContext.broadcast(dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())))
    own_scores = _scores()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, mask = regex.compile(pattern).findall, (1 << _SHIFT) - 1
        known = _packed_table(shared, own_scores) if few else own_scores
        for b in batches:
            counts, langs = [], []
            for t in b.column(len(names)).to_pylist():
                packed = sum(map(known.__getitem__, split(t))) if few and t else sum(known.get(p, 0) for p in split(t)) if t else 0
                counts.append(packed & mask)
                langs.append(language_of(packed))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(counts, pa.int64()), pa.array(langs, pa.string())], names=schema.names)

    if few:
        return source.mapInArrow(run, schema)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        for b in batches:
            keys, found, times = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                each = Counter(split(t))
                keys += [k] * len(each)
                found += each.keys()
                times += each.values()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string()), pa.array(times, pa.int64())], names=["__k", "piece", "times"])

    digest = F.md5("__text").alias("__k")
    pairs = source.where("__text is not null and __text <> ''").select(digest, "__text").mapInArrow(listed, "__k string, piece string, times long")
    pairs = pairs.groupBy("__k", "piece").agg(F.max("times").alias("times"))  # equal texts once
    sums = pairs.join(pieces.select("piece", F.col("tokens").alias("__n")), "piece").groupBy("__k").agg(F.sum(F.col("times") * F.col("__n")).alias("__tokens"))
    with_key = source.withColumn("__k", F.md5("__text"))
    langs = with_key.select(*names, "__k", "__text").mapInArrow(_languages(names, own_scores, pattern), StructType([source.schema[c] for c in names] + [StructField("__k", StringType()), StructField("found_lang", StringType())]))
    return langs.join(sums, "__k", "left").select(*names, F.coalesce("__tokens", F.lit(0).cast("long")).alias("tokens"), "found_lang")


def _languages(names: list[str], scores: dict[str, int], pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        for b in batches:
            langs = [language_of(sum(scores.get(p, 0) for p in split(t))) if t else None for t in b.column(len(names) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names) + 1)), pa.array(langs, pa.string())], names=[*names, "__k", "found_lang"])

    return run


_TABLES: dict[int, dict[str, int]] = {}


def _packed_table(shared, scores: dict[str, int]) -> dict[str, int]:
    """Counts with the language scores above them: one table a worker for each broadcast."""
    table = shared.value
    if id(table) not in _TABLES:
        _TABLES.clear()
        _TABLES[id(table)] = table | {p: table[p] + n for p, n in scores.items() if p in table}
    return _TABLES[id(table)]


_COUNTERS: dict[tuple[str, str], TokenCounter] = {}


def counter(path: str = VOCABULARY, pattern: str = PATTERN) -> TokenCounter:
    """This worker's counter for a vocabulary."""
    if (path, pattern) not in _COUNTERS:
        _COUNTERS[path, pattern] = TokenCounter(path, pattern)
    return _COUNTERS[path, pattern]


#: Characters of text handed to one call, so that its pieces stay small in memory.
BLOCK_CHARS = 1_000_000


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BLOCK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def with_tokens(df, text: str = "text", path: str = VOCABULARY, keep: list[str] | None = None, language: bool = False):
    """``df`` with ``text`` replaced by ``tokens`` (and ``found_lang``); ``keep`` names the columns kept.

    Texts never leave the partition they were read in.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    names = [c for c in (keep if keep is not None else df.columns) if c != text]
    out = [StructField("tokens", IntegerType()), *([StructField("found_lang", StringType())] if language else [])]
    source = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = StructType([source.schema[c] for c in names] + out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            counts: list[int] = []
            langs: list[str | None] = []
            for lo, hi in blocks(texts):
                if language:
                    n, found = c.count_and_language(texts[lo:hi])
                    langs += found
                else:
                    n = c.count(texts[lo:hi])
                counts += n
            cols = [b.column(i) for i in range(len(names))] + [pa.array(counts, pa.int32())]
            if language:
                cols.append(pa.array(langs, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)
