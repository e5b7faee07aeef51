"""Token ids of a corpus in files of directly addressable codes.

A file holds segments of whole documents. In a segment every id is split into 8-bit chunks, lowest
first: level 0 has a chunk of every id, level k + 1 one of each id that level k marks in its
continuation bitmap. A directory holds the number of marks before every 512th bit, so the place of an
id's next chunk is one directory entry plus the popcount of part of one 64-byte line: any id is read
from a few bytes, and nothing around it is decoded.

File: magic, segments, footer (JSON: segments with their documents' number and ids, levels and
offsets), footer length as 8 bytes, magic. A segment: document ids (int64) and null flags, starts
(int64, one more than documents), then of each level chunks, bitmap and directory (int64).
"""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import filesystem, shared_dir, written
from webloom.llm.tokens import encoder

MAGIC = b"WLDAC001"
LINE = 512
#: Ids a segment takes before it is written; bounds a writer's memory.
SEGMENT_IDS = 1 << 21
END_ID = 2


def _levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, directory) of each level."""
    out = []
    rest = ids.astype(np.uint32)
    while True:
        chunks, rest = (rest & 0xFF).astype(np.uint8), rest >> 8
        more = rest > 0
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % (LINE // 8), np.uint8)])
        lines = np.bitwise_count(bitmap.reshape(-1, LINE // 8)).sum(axis=1, dtype=np.int64)
        out.append((chunks, bitmap, np.concatenate([[0], np.cumsum(lines)]).astype(np.int64)))
        rest = rest[more]
        if not len(rest):
            return out


class Writer:
    """Writes one file; it appears under its path when it is complete."""

    def __init__(self, fs, path: str):
        self.fs, self.path, self.draft = fs, path, f"{path}.{uuid.uuid4().hex}.draft"
        self.out = fs.open_output_stream(self.draft, compression=None)
        self.out.write(MAGIC)
        self.at = len(MAGIC)
        self.segments: list[dict] = []
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.held = self.n_ids = self.n_docs = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids))
        self.held += len(ids)
        if self.held >= SEGMENT_IDS:
            self._segment()

    def _put(self, array: np.ndarray) -> int:
        start = self.at
        data = array.tobytes()
        self.out.write(data)
        self.at += len(data)
        return start

    def _segment(self) -> None:
        keys = np.array([k or 0 for k, _ in self.docs], "<i8")
        nulls = np.array([k is None for k, _ in self.docs], np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(x) for _, x in self.docs])]).astype("<i8")
        ids = np.concatenate([x for _, x in self.docs])
        found = {"docs": len(keys), "ids": len(ids), "keys": self._put(keys), "nulls": self._put(nulls), "starts": self._put(starts)}
        found["levels"] = [{"n": len(c), "chunks": self._put(c), "bitmap": self._put(b), "ranks": self._put(r.astype("<i8"))} for c, b, r in _levels(ids)]
        self.segments.append(found)
        self.n_ids += len(ids)
        self.n_docs += len(keys)
        self.docs, self.held = [], 0

    def close(self) -> None:
        if self.docs:
            self._segment()
        footer = json.dumps(self.segments).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.draft, self.path)


class Reader:
    """Random access to a file's ids by segment."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self._read(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no complete token file")
        length = int.from_bytes(tail[:8], "little")
        self.segments = json.loads(self._read(size - 16 - length, length))
        *self.firsts, self.n_ids = accumulate((s["ids"] for s in self.segments), initial=0)

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at) if n else b""

    def _array(self, at: int, n: int, dtype) -> np.ndarray:
        return np.frombuffer(self._read(at, n * np.dtype(dtype).itemsize), dtype)

    def directory(self, segment: int) -> tuple[list[int | None], np.ndarray]:
        """Document ids and the starts of their ids in the segment, with the end."""
        s = self.segments[segment]
        keys, nulls = self._array(s["keys"], s["docs"], "<i8"), self._array(s["nulls"], s["docs"], np.uint8)
        return [None if z else int(k) for k, z in zip(keys, nulls, strict=True)], self._array(s["starts"], s["docs"] + 1, "<i8")

    def _marks_before(self, level: dict, at: int) -> int:
        line, bit = divmod(at, LINE)
        rank = int(self._array(level["ranks"] + 8 * line, 1, "<i8")[0])
        bits = np.unpackbits(self._array(level["bitmap"] + line * (LINE // 8), LINE // 8, np.uint8) if bit else np.zeros(0, np.uint8), bitorder="little")
        return rank + int(bits[:bit].sum())

    def ids(self, segment: int, start: int, n: int) -> np.ndarray:
        """The n ids from start on; reads the chunks of these alone."""
        out = np.zeros(n, np.uint32)
        where = np.arange(n)
        for k, level in enumerate(self.segments[segment]["levels"]):
            if not len(where):
                break
            out[where] |= self._array(level["chunks"] + start, len(where), np.uint8).astype(np.uint32) << np.uint32(8 * k)
            first = start // 8
            bits = np.unpackbits(self._array(level["bitmap"] + first, (start + len(where) + 7) // 8 - first, np.uint8), bitorder="little")
            more = bits[start - 8 * first :][: len(where)].astype(bool)
            start, where = self._marks_before(level, start), where[more]
        return out

    def token(self, segment: int, at: int) -> int:
        return int(self.ids(segment, at, 1)[0])

    def __getitem__(self, at: int) -> int:
        """The at-th id of the file: the segment by bisection of their sizes, then a few bytes."""
        if not 0 <= at < self.n_ids:
            raise IndexError(at)
        segment = bisect_right(self.firsts, at) - 1
        return self.token(segment, at - self.firsts[segment])


class Corpus:
    """Random access to all ids of the files that write_token_files() listed; [(path, base, ids)] is a row a file."""

    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = sorted(files, key=lambda f: f[1])
        self.bases = [f[1] for f in self.files]
        self.open: dict[int, Reader] = {}

    def __getitem__(self, at: int) -> int:
        i = bisect_right(self.bases, at) - 1
        if i < 0 or at >= self.bases[i] + self.files[i][2]:
            raise IndexError(at)
        if i not in self.open:
            self.open[i] = Reader(*filesystem(self.files[i][0]))
        return self.open[i][at - self.bases[i]]


def write_token_files(documents: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the ids of documents(doc_id, text), end_id after each, and return a row per file.

    Files follow ascending doc_id, null last; rows that share a doc_id follow the hash of their text
    (equal texts have equal ids, so their order doesn't show). Null text: the end id only. Columns:
    path, docs, ids, base (ids in all files before it). Rows are dealt by ranges of (doc_id, hash,
    input partition), so a doc_id that very many rows share is split too. Rewriting a lost task's file
    gives the same bytes under the same name. An empty table writes no file.
    """
    spark = documents.sparkSession
    folder = folder or shared_dir(spark, "tokens")

    def encode(batches: Iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.dac"
        enc, tail, writer, first = encoder(tokenizer), np.array([end_id], np.uint32), None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                if first is None:
                    first = (keys[0], part.column("text_hash")[0].as_py())
                    writer = Writer(fs, f"{root}/{name}")
                for key, ids in zip(keys, enc.ids([x or "" for x in texts]), strict=True):
                    writer.add(key, np.concatenate([ids, tail]))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist(
                [{"path": f"{folder}/{name}", "first_id": first[0], "first_hash": first[1], "part": TaskContext.get().partitionId(), "docs": writer.n_docs, "ids": writer.n_ids}],
                pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("first_hash", pa.int64()), ("part", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())]),
            )

    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_hash").asc()]
    rows = rows.withColumn("dealt", F.spark_partition_id()).repartitionByRange(*order, F.col("dealt")).sortWithinPartitions(*order).drop("dealt")
    files = written(rows.mapInArrow(encode, "path string, first_id long, first_hash long, part int, docs long, ids long"), "token-files")
    # one row per file
    before = Window.orderBy(F.col("first_id").asc_nulls_last(), "first_hash", "part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """A row per document from the files that write_token_files() lists.

    doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers).
    """

    def decode(batches: Iterator):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, at = filesystem(path)
                reader = Reader(fs, at)
                for k, segment in enumerate(reader.segments):
                    keys, starts = reader.directory(k)
                    ids = reader.ids(k, 0, segment["ids"]).astype("<u4").tobytes()
                    ends = starts.tolist()
                    crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts[:-1] + base, pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crc, pa.int64())], schema=schema)
                    base += segment["ids"]

    return files.select("path", "base").repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4), "path").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
