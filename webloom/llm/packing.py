"""Documents' token ids packed into training windows of one length.

Bounded-space online packing: a partition keeps a fixed number of open windows. A document's ids are
cut at the window's length; full pieces are windows of their own, the rest goes to the open window
that it fills best. When it fits none, the fullest is emitted and a new one opened. What is open at a
partition's end is merged with other partitions' leftovers, in rounds of a fixed fan-in, by laying
them end to end and cutting at the window's length, so only the last window of all is short.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import written
from webloom.llm.tokenfiles import END_ID
from webloom.llm.tokens import encoder

LENGTH = 4096
OPEN_WINDOWS = 32
#: Partitions, then merge groups, whose leftovers one task takes.
FAN_IN = 128
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, `offset` long, ids binary, open int"
_NAMES = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "open")


class Packer:
    """Best fit into at most `windows` open windows; emitted rows are (piece..., sequence_id, offset)."""

    def __init__(self, length: int, windows: int, first_sequence: int):
        self.length, self.windows, self.next = length, windows, first_sequence
        self.rooms: list[tuple[int, int]] = []  # (room left, sequence), ascending
        self.held: dict[int, list[tuple]] = {}

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        total = len(ids)
        at = 0
        while total - at >= self.length:
            yield (key, at, self.length, total, self._new(), 0, ids[at : at + self.length].tobytes(), 0)
            at += self.length
        n = total - at
        if not n:
            return
        i = bisect_left(self.rooms, (n, -1))
        if i == len(self.rooms):
            if len(self.rooms) >= self.windows:
                yield from self.held.pop(self.rooms.pop(0)[1])
            room, sequence = self.length, self._new()
            self.held[sequence] = []
        else:
            room, sequence = self.rooms.pop(i)
        self.held[sequence].append((key, at, n, total, sequence, self.length - room, ids[at:].tobytes(), 0))
        if room == n:
            yield from self.held.pop(sequence)
        else:
            insort(self.rooms, (room - n, sequence))

    def leftovers(self, group: int) -> Iterator[tuple]:
        for rows in self.held.values():
            for row in rows:
                yield (*row[:7], group)


def _batches(rows: Iterator[tuple], size: int = 4096):
    import pyarrow as pa

    kinds = [pa.int64()] * 6 + [pa.binary(), pa.int32()]
    held: list[tuple] = []
    bulk = 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=list(_NAMES))

    for row in rows:
        held.append(row)
        bulk += len(row[6])
        if len(held) >= size or bulk >= 16 << 20:
            yield batch()
            held, bulk = [], 0
    if held:
        yield batch()


def pack_documents(documents: DataFrame, tokenizer: str, length: int = LENGTH, windows: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    A document's tokens are its text's ids and end_id; null text: end_id alone. Every id lies in one
    piece, pieces lie gapless from offset 0 in their sequence. Repeated rows are packed as often as
    they occur, rows of null doc_id like others. Memory: the open windows, and a batch of texts. Ids are
    computed once and written to the shared folder; leftovers are a bounded number of windows per
    partition. Which documents share a sequence depends on the input's partitions.
    """

    def place(batches: Iterator):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, tail, packer = encoder(tokenizer), np.array([end_id], np.uint32), Packer(length, windows, part << 32)

        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    some = batch.slice(at, 512)
                    texts = [x or "" for x in some.column("text").to_pylist()]
                    for key, ids in zip(some.column("doc_id").to_pylist(), enc.ids(texts), strict=True):
                        yield from packer.add(key, np.concatenate([ids, tail]).astype("<u4"))
            yield from packer.leftovers(1 + part)

        yield from _batches(rows())

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = written(rows.mapInArrow(place, SCHEMA), "packed")
    out, left = placed.where("open = 0"), placed.where("open > 0")
    groups = (placed.select(F.max("open")).first()[0] or 0) + 1
    level = 0
    while groups:
        level += 1
        groups = 0 if groups <= FAN_IN else (groups - 1) // FAN_IN + 1
        merged = written(_merged(left, length, level, final=not groups), f"packed-merge-{level}")
        out, left = out.unionByName(merged.where("open = 0")), merged.where("open > 0")
    return out.drop("open")


def _merged(left: DataFrame, length: int, level: int, final: bool) -> DataFrame:
    """Leftovers of FAN_IN groups laid end to end; but for the final round, the last window stays open."""

    def lay(batches: Iterator):
        tail: list[tuple] = []

        def ended(group: int) -> list[tuple]:
            return tail if final else [(*row[:7], group + 1) for row in tail]

        def rows():
            nonlocal tail
            group, sequence, offset = -1, 0, 0
            for batch in batches:
                for at_group, key, start, n, total, ids in zip(*(batch.column(c).to_pylist() for c in ("group", "doc_id", "start", "length", "doc_tokens", "ids")), strict=True):
                    if at_group != group:
                        yield from ended(group)
                        tail, group, sequence, offset = [], at_group, ((level << 24) + at_group) << 32, 0
                    at = 0
                    while at < n:
                        take = min(n - at, length - offset)
                        tail.append((key, start + at, take, total, sequence, offset, ids[4 * at : 4 * (at + take)], 0))
                        at, offset = at + take, offset + take
                        if offset == length:
                            yield from tail
                            tail, sequence, offset = [], sequence + 1, 0
            yield from ended(group)

        yield from _batches(rows())

    keyed = left.withColumn("group", F.expr(f"(open - 1) div {FAN_IN}"))
    return keyed.repartition("group").sortWithinPartitions("group", "sequence_id", "offset").mapInArrow(lay, SCHEMA)
