"""Sitemaps and their indexes: unpacked, read, and expanded level by level."""

from __future__ import annotations

import re
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.functions.udfs import arrow_udf
from webloom.functions.urls import normalize_url
from webloom.operators.order import checkpointed

MAX_BYTES = 50 * 1024 * 1024
MAX_FILES = 500
MAX_URLS = 50_000
_GZIP = b"\x1f\x8b"


def unpack(body: bytes, limit: int = MAX_BYTES) -> bytes:
    """Gzip, told by its first bytes, of one member or more; ValueError beyond the limit or if broken."""
    out = b""
    if body.startswith(_GZIP):
        while body.startswith(_GZIP) and len(out) <= limit:
            member = zlib.decompressobj(31)
            try:
                out += member.decompress(body, limit + 1 - len(out))
            except zlib.error as error:
                raise ValueError(f"broken gzip archive: {error}") from error
            body = member.unused_data
    else:
        out = body
    if len(out) > limit:
        raise ValueError(f"larger than {limit} bytes")
    return out


def parse_sitemap(body: bytes | None, limit: int = MAX_BYTES) -> dict:
    """{is_index, locations, error}: canonical URLs in file order, invalid ones left out."""
    bad = {"is_index": False, "locations": []}
    try:
        document = unpack(body or b"", limit).lstrip()
        if b"<!ENTITY" in document[:65536]:
            document = re.sub(rb"<!DOCTYPE[^\[>]*\[.*?\]\s*>", b"", document, count=1, flags=re.DOTALL)
        root = ElementTree.fromstring(document)
    except ElementTree.ParseError as error:
        return bad | {"error": f"not an XML document: {error}"}
    except ValueError as error:
        return bad | {"error": str(error)}
    kind = root.tag.rpartition("}")[2]
    entry = {"urlset": "url", "sitemapindex": "sitemap"}.get(kind)
    if entry is None:
        return bad | {"error": f"not a sitemap: the root element is <{kind}>"}
    found = (normalize_url(x.text or "") for e in root if e.tag.rpartition("}")[2] == entry for x in e if isinstance(x.tag, str) and x.tag.rpartition("}")[2] == "loc")
    return {"is_index": entry == "sitemap", "locations": [re.sub(r"^(https?://)[^/?#]*@", r"\1", u) for u in found if u], "error": None}


@arrow_udf("is_index boolean, locations array<string>, error string")
def _parsed(bodies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_sitemap(b) for b in bodies], columns=["is_index", "locations", "error"])


def read_sitemaps(files: DataFrame) -> DataFrame:
    """files(url, body) -> url, is_index, locations, error."""
    return files.withColumn("s", _parsed(F.col("body"))).select("url", "s.is_index", "s.locations", "s.error")


def _first(df: DataFrame, key: str, order: list) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def expand(files: DataFrame, roots: DataFrame, max_urls: int = MAX_URLS, max_files: int = MAX_FILES) -> DataFrame:
    """(root, url, pos): the pages that each of roots(url) lists, in order of listing, each once, max_urls at most.

    Index files are followed breadth first to files of their own host, a file once a root and max_files of
    them; what can't be read counts as empty. Reads happen per level, so the loop is as long as indexes nest.
    """
    parsed = read_sitemaps(files.withColumn("url", urls.normalized(F.col("url"))))
    level = roots.select(urls.normalized(F.col("url")).alias("root")).where("root is not null").distinct().select("root", F.col("root").alias("file"), F.array(F.lit(0)).alias("path"))
    known = level
    pages = None
    while True:
        met = level.join(parsed, level.file == parsed.url).drop("url")
        listed = met.where("error is null").select("root", "file", "path", "is_index", F.posexplode("locations").alias("pos", "location"))
        found = listed.where("not is_index").select("root", F.col("location").alias("url"), F.concat("path", F.array("pos")).alias("path"))
        pages = found if pages is None else pages.unionByName(found)
        own = urls.host(F.col("location")) == urls.host(F.col("file"))
        deeper = listed.where(F.col("is_index") & own).select("root", F.col("location").alias("file"), F.concat("path", F.array("pos")).alias("path"))
        deeper = _first(deeper.withColumn("__key", F.concat_ws(" ", "root", "file")), "__key", ["path"]).drop("__key").join(known.select("root", "file"), ["root", "file"], "left_anti")
        counts = known.groupBy("root").agg(F.count(F.lit(1)).alias("__known"))
        rank = F.row_number().over(Window.partitionBy("root").orderBy("path"))
        level = deeper.join(counts, "root").withColumn("__n", rank).where(F.col("__n") + F.col("__known") <= max_files).select("root", "file", "path")
        level = checkpointed(level)
        if level.isEmpty():
            break
        known = known.unionByName(level)
    depth_first = [F.size("path"), F.col("path")]
    once = _first(pages.withColumn("__key", F.concat_ws(" ", "root", "url")), "__key", depth_first).drop("__key")
    ranked = once.withColumn("pos", F.row_number().over(Window.partitionBy("root").orderBy(*depth_first)) - 1)
    return ranked.where(F.col("pos") < max_urls).select("root", "url", "pos")


def locations(document: Column) -> Column:
    """<loc> texts of well-formed XML, by the built-in XPath."""
    return F.xpath(document, F.lit("//*[local-name()='loc']/text()"))
