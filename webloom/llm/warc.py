"""WARC archives: written as one gzip stream a file, normalised to a gzip member a record, read by offset.

* write_archives(): records of pages, a file per task, each a single (monolithic) gzip stream.
* normalise_archives(): inflates each such stream once, rewrites every record as a gzip member of its own
  and writes a sidecar index (JSON lines: offset, length and what identifies the record) beside it.
* read_archives(): seeks to each record by the index, inflates its member alone and checks its digest.

Files appear under their names when complete; a task that is run again rewrites the same files.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import filesystem, shared_dir, written

#: Payloads below this size are stored each time.
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
_HEADER_END = b"\r\n\r\n"


def with_record_types(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """pages(page_id, url, html) with payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads of revisit_bytes and more, that with the smallest page_id is the response; rows
    that repeat this page_id are responses too, and where no row of a payload has a page_id, all are.
    Only digests that occur twice or more are joined back, and of these one row each.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    repeated = rows.where(F.col("payload_bytes") >= revisit_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = written(repeated, "warc-repeated").withColumnRenamed("payload_digest", "digest")
    joined = rows.join(repeated, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") >= revisit_bytes), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _uri(url: str | None, page_id: int | None) -> str:
    """A URI for a header line: no white space or control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")


def record(row: dict, date: str) -> bytes:
    """A WARC/1.1 record of a page; a revisit holds the HTTP header, not the payload."""
    payload = row["html"].encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", _record_id(row["page_id"], row["payload_digest"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(row["url"], row["page_id"])),
        ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if row["page_id"] is not None:
        head.append(("X-Page-Id", str(row["page_id"])))
    if row["record_type"] == "revisit":
        head += [("WARC-Refers-To", _record_id(row["refers_to"], row["payload_digest"])), ("X-Refers-To-Page-Id", str(row["refers_to"])), ("WARC-Profile", PROFILE)]
        payload = b""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", len(http) + len(payload))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + http + payload + _HEADER_END


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line is left out."""
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k.strip()}


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """One monolithic .warc.gz per task that has rows; returns (path, records)."""

    def write(batches: Iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"whole-{TaskContext.get().partitionId():06d}.warc.gz"
        draft = f"{root}/{name}.{uuid.uuid4().hex}.draft"
        out, n, gz = None, 0, zlib.compressobj(level, zlib.DEFLATED, 31)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    out = out or fs.open_output_stream(draft, compression=None)
                    out.write(gz.compress(record(row, date)))
                    n += 1
        if out:
            out.write(gz.flush())
            out.close()
            fs.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n}])

    return written(records.mapInArrow(write, "path string, records long"), "warc-files")


class _Inflated:
    """A forward reader of a gzip file of any number of members."""

    def __init__(self, stream):
        self.stream, self.buffer, self.z, self.ended = stream, bytearray(), zlib.decompressobj(31), False

    def more(self) -> bool:
        while not self.ended:
            data = self.z.unused_data if self.z.eof else b""
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            data = data or self.stream.read(CHUNK)
            if not data:
                self.ended = True
                return False
            got = self.z.decompress(data)
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("the archive ends in a record's header")
                return None
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise ValueError("the archive ends in a record's block")
            part = bytes(self.buffer[: min(n, CHUNK)])
            del self.buffer[: len(part)]
            n -= len(part)
            yield part


def normalise_file(fs, source: str, target: str, level: int = 4) -> list[dict]:
    """Rewrite source as target, a gzip member per record; returns and writes (target + ".idx") the index.

    Memory: a chunk, whatever a record's size.
    """
    index: list[dict] = []
    draft = f"{target}.{uuid.uuid4().hex}.draft"
    with fs.open_input_stream(source, compression=None) as raw, fs.open_output_stream(draft, compression=None) as out:
        data, at = _Inflated(raw), 0
        while (head := data.until(_HEADER_END)) is not None:
            head = head.lstrip(b"\r\n")
            got = fields(head[: -len(_HEADER_END)])
            gz = zlib.compressobj(level, zlib.DEFLATED, 31)
            out.write(gz.compress(head))
            for part in data.take(int(got["content-length"]) + len(_HEADER_END)):
                out.write(gz.compress(part))
            out.write(gz.flush())
            end = out.tell()
            index.append({"offset": at, "length": end - at, "type": got["warc-type"], "uri": got.get("warc-target-uri"), "digest": got.get("warc-payload-digest"), "record_id": got.get("warc-record-id")})
            at = end
    fs.move(draft, target)
    with fs.open_output_stream(f"{draft}.idx", compression=None) as out:
        out.write("".join(json.dumps(x) + "\n" for x in index).encode())
    fs.move(f"{draft}.idx", f"{target}.idx")
    return index


def normalise_archives(files: DataFrame, folder: str) -> DataFrame:
    """Normalise the archives that files(path) lists into folder, a task for each; returns (path, records)."""

    def normalise(batches: Iterator):
        import pyarrow as pa

        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = path.rpartition("/")[2]
                index = normalise_file(fs, filesystem(path)[1], f"{root}/{name}")
                yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": len(index)}])

    n = max(1, files.sparkSession.sparkContext.defaultParallelism * 4)
    return written(files.select("path").repartition(n, "path").mapInArrow(normalise, "path string, records long"), "warc-normalised")


def read_record(fs, path: str, entry: dict) -> dict:
    """The record at an index entry, from its own member; digests of responses are checked."""
    with fs.open_input_file(path) as f:
        return _parsed(f.read_at(entry["length"], entry["offset"]))


def _parsed(member: bytes) -> dict:
    data = zlib.decompress(member, 31)
    head, _, block = data.partition(_HEADER_END)
    got = fields(head)
    block = block[: int(got["content-length"])]
    http, _, payload = block.partition(_HEADER_END)
    digest = got["warc-payload-digest"].removeprefix("sha256:")
    length = int(fields(http)["content-length"])
    if got["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"the payload of {got['warc-record-id']} isn't what its header says")
    page, refers = got.get("x-page-id"), got.get("x-refers-to-page-id")
    return {"page_id": page and int(page), "url": got["warc-target-uri"], "payload": payload, "payload_bytes": length, "payload_digest": digest, "record_type": got["warc-type"], "refers_to": refers and int(refers)}


def read_archives(files: DataFrame) -> DataFrame:
    """A row per record of normalised archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def read(batches: Iterator):
        import pyarrow as pa

        kinds = dict(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True))
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                fs, path = filesystem(uri)
                with fs.open_input_stream(f"{path}.idx", compression=None) as f:
                    index = [json.loads(x) for x in f.read().decode().splitlines()]
                with fs.open_input_file(path) as f:
                    for at in range(0, len(index), 1000):
                        rows = [_parsed(f.read_at(x["length"], x["offset"])) for x in index[at : at + 1000]]
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=names)

    n = max(1, files.sparkSession.sparkContext.defaultParallelism * 4)
    return files.select("path").repartition(n, "path").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages(page_id, url, html) as monolithic archives, normalise these, and read them back.

    Null html: an empty payload. Null url: urn:page:<page_id>. Repeated rows are records each. An empty
    table makes no archive. The whole-stream archives stay in <folder>/whole, the others in
    <folder>/records. Writing into a folder again replaces archives of the same names; those of an earlier,
    larger table stay there, but only the archives just written are read back.
    """
    folder = folder or shared_dir(pages.sparkSession, "warc")
    whole = write_archives(with_record_types(pages), f"{folder}/whole")
    return read_archives(normalise_archives(whole, f"{folder}/records"))
