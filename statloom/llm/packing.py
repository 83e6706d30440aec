"""Filling fixed-capacity containers: harmonic packing, independent in every partition.

Lengths are partitioned into reciprocal-capacity classes: class k holds lengths in (C/(k+1), C/k],
so exactly k items of it fit a container whatever they are.  Every worker fills each class's
containers with that fixed count from its own rows, so nothing is shuffled.  Two refinements keep
the space that pure harmonic packing leaves: the room left in a container is topped up with the
largest waiting item that fits, and containers are opened largest class first so that the small
classes serve as fill.  Rows are handled in blocks of (key, length), never with their texts.

Defined edge cases: an item above the capacity becomes full containers plus a rest that is packed
like an item; null and empty texts have 0 tokens and take no room (they join any container);
repeated keys are items of their own.  A container id is ``<partition>-<n>``: which items share a
container follows from how the input is split over workers (as the method has it, they work
independently); that every item is placed once and no container is too full does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from statloom.llm.tokens import VOCABULARY, with_tokens

#: Items packed together by one worker.  A parameter of the result as well: a worker's items go into
#: containers of their own every so many, so each such group leaves at most one container half empty.
BLOCK_ITEMS = 250_000


class _Waiting:
    """Items by length, with the largest length that is at most some room (bitmap of lengths)."""

    def __init__(self, capacity: int):
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.lengths = 0

    def add(self, item: int, length: int) -> None:
        self.at[length].append(item)
        self.lengths |= 1 << length

    def take(self, room: int, least: int = 0) -> tuple[int, int] | None:
        below = self.lengths & ((1 << (room + 1)) - 1)
        length = below.bit_length() - 1
        if length < max(least, 0):
            return None
        item = self.at[length].pop()
        if not self.at[length]:
            self.lengths ^= 1 << length
        return item, length


def harmonic_class(length: int, capacity: int) -> int:
    """k such that length lies in (C/(k+1), C/k]; 0 tokens belong to the last class, C."""
    return capacity // length if length else capacity


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers; every length must be at most the capacity."""
    waiting = _Waiting(capacity)
    for i, n in enumerate(lengths):
        waiting.add(i, n)
    containers: list[list[int]] = []
    while waiting.lengths:
        item, length = waiting.take(capacity)  # the largest that is left opens a container
        k = harmonic_class(length, capacity)
        members, room = [item], capacity - length
        low = capacity // (k + 1) + 1 if k < capacity else 0
        while len(members) < k and (more := waiting.take(room, low)):  # the class's fixed count
            members.append(more[0])
            room -= more[1]
        while more := waiting.take(room):  # the room that harmonic packing would leave
            members.append(more[0])
            room -= more[1]
        containers.append(members)
    return containers


def pack_documents(documents: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """One row per placed part: key, part (0 unless divided), first token, tokens, harmonic class,
    container, and the tokens the container holds in all."""
    return pack_sized(with_tokens(documents, text=text, path=path, keep=[key]), capacity, key)


def pack_sized(sized: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """As :func:`pack_documents`, for (key, tokens) rows."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = sized.select(key, "tokens")
    schema = StructType([
        sized.schema[key], StructField("part", IntegerType()), StructField("first_token", IntegerType()), StructField("tokens", IntegerType()),
        StructField("class", IntegerType()), StructField("container_id", StringType()), StructField("container_tokens", IntegerType()), StructField("capacity", IntegerType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id = TaskContext.get().partitionId()
        opened = 0
        kept: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal opened
            whole = pa.Table.from_batches(kept).combine_chunks()
            kept.clear()
            tokens = whole.column(1).to_pylist()
            row, first, size, part, lengths, items = [], [], [], [], [], []
            full: list[int] = []
            for r, n in enumerate(tokens):
                p = 0
                while n > capacity:  # full containers first
                    full.append(len(row))
                    row.append(r), first.append(p * capacity), size.append(capacity), part.append(p)
                    n -= capacity
                    p += 1
                items.append(len(row))
                lengths.append(n)
                row.append(r), first.append(p * capacity), size.append(n), part.append(p)
            groups = [[i] for i in full] + [[items[i] for i in g] for g in pack(lengths, capacity)]
            order = [i for g in groups for i in g]
            ids = [f"{part_id}-{opened + c}" for c, g in enumerate(groups) for _ in g]
            held = [t for g in groups for t in [sum(size[i] for i in g)] for _ in g]
            opened += len(groups)
            pick = lambda x: [x[i] for i in order]
            cols = [
                whole.column(0).combine_chunks().take(pa.array(pick(row), pa.int64())),
                pa.array(pick(part), pa.int32()), pa.array(pick(first), pa.int32()), pa.array(pick(size), pa.int32()),
                pa.array([harmonic_class(size[i], capacity) for i in order], pa.int32()), pa.array(ids, pa.string()),
                pa.array(held, pa.int32()), pa.array([capacity] * len(order), pa.int32()),
            ]
            table = pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=schema.names)
            yield from table.to_batches(max_chunksize=50_000)

        held_rows = 0
        for b in batches:
            kept.append(b)
            held_rows += b.num_rows
            if held_rows >= BLOCK_ITEMS:
                yield from flush()
                held_rows = 0
        if held_rows:
            yield from flush()

    return sized.mapInArrow(run, schema)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per number of harmonic class of a container's largest item: containers, tokens, fill."""
    per = packed.groupBy("container_id").agg(
        F.min("class").alias("class"), F.count("*").alias("items"), F.first("container_tokens").alias("held"), F.first("capacity").alias("capacity")
    )
    return per.groupBy("capacity", "class").agg(
        F.count("*").alias("n_containers"),
        F.sum("items").alias("n_items"),
        F.sum(F.col("held").cast("long")).alias("tokens"),
        F.round(F.sum(F.col("held").cast("double")) / F.sum(F.col("capacity").cast("double")), 6).alias("fill"),
    )
