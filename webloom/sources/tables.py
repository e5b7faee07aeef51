"""Sources and sinks: URL lists, cookies, page records as JSON, CSV, Parquet and SQLite."""

from __future__ import annotations

import json
import os
import re
import sqlite3
from collections.abc import Iterator, Sequence
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from webloom.functions import urls
from webloom.functions.text import escaped_formula, unescaped_formula
from webloom.operators.order import checkpointed
from webloom.operators.pages import PAGE_RECORD

RECORD_FIELDS = [f.strip().split(" ")[0] for f in PAGE_RECORD.split(", ")]


def read_urls(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(urls(url, line), problems(line, problem, value)) of a UTF-8 list, a URL a line; blank lines and # lines are skipped.

    The first of equal lines keeps its place. Lines are numbered per file, which is read whole as lists are small files.
    """
    text = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    files = spark.read.format("binaryFile").load(path).select(text.alias("text"))
    lines = files.select(F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line", "raw")).select((F.col("line") + 1).alias("line"), F.trim(F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")).alias("url"))
    lines = lines.where((F.col("url") != "") & ~F.col("url").startswith("#"))
    spaced = F.col("url").rlike(r"(?U)[\s\x00-\x1f\x7f-\x9f]")
    bad = F.when(spaced, "a URL has no spaces or control characters").when(urls.normalized(F.col("url")).isNull(), "expected an absolute http(s) URL")
    judged = lines.withColumn("problem", bad)
    good = judged.where("problem is null").groupBy("url").agg(F.min("line").alias("line"))
    return good, judged.where("problem is not null").select("line", "problem", F.col("url").alias("value"))


def read_cookies(spark: SparkSession, path: str, now: float) -> DataFrame:
    """Live cookies of a Netscape cookies.txt: host, subdomains, path, secure, expires, name, value, http_only.

    0 is a session cookie's date; dates beyond the year 9999 are milliseconds; those of addresses and without names are left out.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line")).where("line != ''")
    http_only = F.col("line").startswith("#HttpOnly_")
    kept = lines.where(http_only | ~F.col("line").startswith("#")).select(http_only.alias("http_only"), F.split(F.regexp_replace("line", "^#HttpOnly_", ""), "\t").alias("f"))
    at = F.expr("try_cast(f[4] as double)")
    far = 253402300799.0
    expires = F.when(at == 0, F.lit(None)).when(at > far, F.floor(at / 1000).cast("double")).otherwise(at)
    rows = kept.where(F.size("f") == 7).select(F.col("f")[0].alias("host"), (F.col("f")[1] == "TRUE").alias("subdomains"), F.col("f")[2].alias("path"), (F.col("f")[3] == "TRUE").alias("secure"), expires.alias("expires"), F.col("f")[5].alias("name"), F.col("f")[6].alias("value"), "http_only")
    return rows.where((F.col("expires").isNull() | ((F.col("expires") > now) & (F.col("expires") <= far))) & (F.col("name") != "") & ~F.col("host").rlike(r"^[0-9.]+$|:"))


# Page records


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or one indented array a file."""
    array = not path.endswith((".jsonl", ".ndjson"))
    return spark.read.schema(PAGE_RECORD).option("mode", "FAILFAST").option("multiLine", array).json(path)


def write_json_records(records: DataFrame, path: str, mode: str = "append") -> None:
    records.select(*RECORD_FIELDS).write.mode(mode).option("ignoreNullFields", "false").json(path)


def export_json_array(records: DataFrame, path: str) -> int:
    """One local file with an indented array; records are streamed to it partition by partition."""
    n = 0
    draft = f"{path}.draft"
    with open(draft, "w", encoding="utf-8") as out:
        out.write("[")
        for row in records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            body = json.dumps(json.loads(row["j"]), ensure_ascii=False, indent=2)
            out.write(("," if n else "") + "\n" + re.sub("^", "  ", body, flags=re.MULTILINE))
            n += 1
        out.write("\n]\n")
    os.replace(draft, path)
    return n


def write_csv_records(records: DataFrame, path: str, mode: str = "append", escape_formulas: bool = True) -> None:
    """Header, quoted cells, nested values as JSON, times in ISO 8601; cells that a spreadsheet would run are escaped."""
    cells = []
    for f in records.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f.name)
        if kind in ("array", "struct", "map"):
            c = F.to_json(c)
        elif kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        elif kind == "string" and escape_formulas:
            c = escaped_formula(c)
        cells.append(c.alias(f.name))
    records.select(*cells).write.mode(mode).options(header=True, escape='"', quote='"', lineSep="\n", emptyValue="").csv(path)


def read_csv_records(spark: SparkSession, path: str, escape_formulas: bool = True) -> DataFrame:
    """The inverse of write_csv_records() for page records; an empty cell is an empty text."""
    schema = ", ".join(f"{n} STRING" for n in RECORD_FIELDS)
    raw = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', quote='"', mode="FAILFAST", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    text = {n: F.coalesce(unescaped_formula(F.col(n)) if escape_formulas else F.col(n), F.lit("")).alias(n) for n in ("url", "title", "text", "metadata", "content_type")}
    typed = {"links": F.from_json("links", "array<string>").alias("links"), "crawled_at": F.to_timestamp("crawled_at").alias("crawled_at"), "status_code": F.col("status_code").cast("int").alias("status_code")}
    return raw.select(*[text.get(n, typed.get(n)) for n in RECORD_FIELDS])


def upsert_parquet(spark: SparkSession, batch: DataFrame, path: str, order: str = "crawled_at", buckets: int | None = None, key: str | Sequence[str] = "url") -> None:
    """Write batch into a Parquet table keyed by url, or other columns, the latest record winning: a new version beside the old, then a pointer to it.

    The pointer (a one-row table) is written last, so readers and reruns see a whole version.
    """
    from webloom.operators.frontier import upsert_latest

    pointer = f"{path}/current"
    old = _version(spark, path)
    stored = spark.read.parquet(f"{path}/v{old}") if old else batch.limit(0)
    merged = upsert_latest(stored, batch, key, order)
    if buckets:
        merged = merged.repartition(buckets, *([key] if isinstance(key, str) else key))
    merged.write.mode("overwrite").parquet(f"{path}/v{old + 1}")
    spark.createDataFrame([(old + 1,)], "version int").coalesce(1).write.mode("overwrite").parquet(pointer)


def _version(spark: SparkSession, path: str) -> int:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("version int").parquet(f"{path}/current").agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        return 0


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_RECORD).parquet(f"{path}/v{_version(spark, path)}")


def valid_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records to write, quarantined ones with why): one bad record doesn't cost its batch."""
    why = F.when(F.col("url").isNull(), "no url").when(~F.col("url").rlike("^https?://"), "not an http(s) URL").when(F.col("crawled_at").isNull(), "no time")
    marked = records.withColumn("rejected", why)
    return marked.where("rejected is null").drop("rejected"), marked.where("rejected is not null")


def bounded_buffer(records: DataFrame, batch_size: int, order: str = "seq", batches: int = 10) -> DataFrame:
    """The oldest records that a buffer holds while its sink is down."""
    return records.orderBy(order).limit(batch_size * batches)


def write_all(records: DataFrame, writers: dict[str, callable], attempts: int = 3) -> DataFrame:
    """Write to several sinks from one computation; (url, sink, error) acknowledgements, a row a record and sink.

    A sink that fails is tried again, `attempts` times in all; its records are acknowledged with the last error. The others
    get theirs all the same. Acknowledgements are made from records, on the executors.
    """
    kept = checkpointed(records)
    acks = {name: _written(kept, write, attempts) for name, write in writers.items()}
    listed = F.array(*[F.struct(F.lit(name).alias("sink"), F.lit(error).cast("string").alias("error")) for name, error in acks.items()])
    return kept.select("url", F.inline(listed))


def _written(records: DataFrame, write, attempts: int) -> str | None:
    """The last error; None: written."""
    error = None
    for _ in range(attempts):
        try:
            write(records)
            return None
        except Exception as e:  # whatever a sink raises is its own affair
            error = f"{type(e).__name__}: {e}"[:200]
    return error


def settled(acks: DataFrame, sinks: int) -> DataFrame:
    """(url, dropped): settled in all sinks; dropped if any of them failed."""
    return acks.groupBy("url").agg(F.countDistinct("sink").alias("n"), F.max(F.col("error").isNotNull()).alias("dropped")).where(F.col("n") == sinks).drop("n")


def writer_for(path: str):
    """The sink that a path's ending or scheme names: (name, function of a frame)."""
    ending = Path(urlsplit(path).path).suffix.lower()
    known = {
        ".jsonl": write_json_records, ".ndjson": write_json_records, ".json": lambda df, p: export_json_array(df, p), ".csv": write_csv_records,
        ".parquet": lambda df, p: df.write.mode("append").parquet(p), ".db": write_sqlite, ".sqlite": write_sqlite, ".sqlite3": write_sqlite,
    }
    scheme = path.partition("://")[0] if "://" in path else ""
    if scheme in SCHEMES:
        return scheme, lambda df: SCHEMES[scheme](df, path)
    if ending not in known:
        raise ValueError(f"no sink for {path!r}")
    return ending[1:], lambda df: known[ending](df, path)


SCHEMES = {"sqlite": lambda df, url: write_sqlite(df, url.removeprefix("sqlite:///"))}


def register_scheme(name: str, write) -> None:
    """Add a sink for URLs of a scheme: write(frame, url)."""
    SCHEMES[name] = write


# SQLite, by the Python data source API

_DDL = "CREATE TABLE IF NOT EXISTS pages (id INTEGER PRIMARY KEY, url TEXT UNIQUE NOT NULL, title TEXT, text TEXT, links TEXT, metadata TEXT, crawled_at TEXT, status_code INTEGER, content_type TEXT)"
_STORED = "url STRING, title STRING, text STRING, links STRING, metadata STRING, crawled_at STRING, status_code INT, content_type STRING"


class _Reader(DataSourceReader):
    def __init__(self, path: str, parts: int):
        self.path, self.parts = path, parts

    def partitions(self):
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition) -> Iterator[tuple]:
        with sqlite3.connect(self.path) as db:
            yield from db.execute(f"SELECT {', '.join(RECORD_FIELDS)} FROM pages WHERE id % ? = ? ORDER BY id", (self.parts, partition.value))


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path
        with sqlite3.connect(path, timeout=30) as db:
            db.execute("PRAGMA journal_mode=WAL")
            db.execute(_DDL)
            for c in ("crawled_at", "status_code"):
                db.execute(f"CREATE INDEX IF NOT EXISTS pages_{c} ON pages ({c})")

    def write(self, rows):
        marks = ", ".join("?" * len(RECORD_FIELDS))
        sets = ", ".join(f"{c} = excluded.{c}" for c in RECORD_FIELDS if c != "url")
        with sqlite3.connect(self.path, timeout=30) as db:
            db.executemany(f"INSERT INTO pages ({', '.join(RECORD_FIELDS)}) VALUES ({marks}) ON CONFLICT (url) DO UPDATE SET {sets}", (tuple(r) for r in rows))
        return WriterCommitMessage()


class SqliteSource(DataSource):
    """format("webloom_sqlite"): page records of a file that driver and executors share; option path, option parts."""

    @classmethod
    def name(cls):
        return "webloom_sqlite"

    def schema(self):
        return _STORED

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("parts", 1)))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def write_sqlite(records: DataFrame, path: str) -> None:
    """Upsert page records; one writer, as SQLite has."""
    spark = records.sparkSession
    spark.dataSource.register(SqliteSource)
    rows = records.select("url", "title", "text", F.to_json("links").alias("links"), "metadata", F.date_format("crawled_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("crawled_at"), "status_code", "content_type")
    rows.coalesce(1).write.format("webloom_sqlite").option("path", path).mode("append").save()


def read_sqlite(spark: SparkSession, path: str, parts: int = 1) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    rows = spark.read.format("webloom_sqlite").option("path", path).option("parts", str(parts)).load()
    return rows.withColumn("links", F.from_json("links", "array<string>")).withColumn("crawled_at", F.to_timestamp("crawled_at"))


def latest_first(records: DataFrame) -> DataFrame:
    """Each URL's latest record."""
    return records.withColumn("__n", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("crawled_at")))).where("__n = 1").drop("__n")
