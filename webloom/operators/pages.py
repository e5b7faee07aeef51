"""Pages to structured fields: one parse a page, then plain column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import html, urls
from webloom.functions.udfs import arrow_udf
from webloom.operators.order import merged

METADATA = "title STRING, description STRING, keywords ARRAY<STRING>, language STRING, canonical STRING, robots ARRAY<STRING>"
PARSED = (
    f"url STRING, final_url STRING, title STRING, text STRING, links ARRAY<STRING>, metadata STRUCT<{METADATA.replace(' STRING', ': STRING').replace(' ARRAY', ': ARRAY')}>, "
    "headings ARRAY<STRUCT<level: INT, text: STRING>>, images ARRAY<STRUCT<src: STRING, alt: STRING>>, "
    "tables ARRAY<STRUCT<caption: STRING, headers: ARRAY<STRING>, rows: ARRAY<ARRAY<STRING>>>>, lists ARRAY<STRUCT<type: STRING, items: ARRAY<STRING>>>, "
    "errors ARRAY<STRING>, problem STRING"
)
FIELDS = ("url", "final_url", "title", "text", "links", "metadata", "headings", "images", "tables", "lists", "errors", "problem")
PAGE_RECORD = "url STRING, title STRING, text STRING, links ARRAY<STRING>, metadata STRING, crawled_at TIMESTAMP, status_code INT, content_type STRING"


def parsed(html_: Column, url: Column, final_url: Column | None = None, content_type: Column | None = None, **options) -> Column:
    """A struct of type PARSED; options: same_host_only, skip_nofollow, robots_name, bare_references, and fields, the only ones to be read (title comes with metadata)."""

    @arrow_udf(PARSED)
    def parse(bodies: pd.Series, at: pd.Series, final: pd.Series, types: pd.Series) -> pd.DataFrame:
        rows = [html.parse_page(b, u, f, t, **options) for b, u, f, t in zip(bodies, at, final, types, strict=True)]
        return pd.DataFrame(rows, columns=list(FIELDS))

    none = F.lit(None).cast("string")
    return parse(html_, url, none if final_url is None else final_url, none if content_type is None else content_type)


def parse_pages(pages: DataFrame, url: str = "url", body: str = "html", **options) -> DataFrame:
    """pages with the struct column `page`."""
    return pages.withColumn("page", parsed(F.col(body), F.col(url), **options))


def links(parsed_pages: DataFrame) -> DataFrame:
    """(src, dst, pos): the link graph of parsed pages, each target once a page, in page order."""
    return parsed_pages.select(F.col("page.final_url").alias("src"), F.posexplode("page.links").alias("pos", "dst")).select("src", "dst", "pos")


def page_records(df: DataFrame, depth: Column, crawled_at: Column) -> DataFrame:
    """Stored page records from rows with page, status and content_type."""
    details = F.struct(
        "page.metadata.description", "page.metadata.keywords", "page.metadata.language", "page.metadata.canonical", "page.metadata.robots",
        "page.headings", "page.images", "page.tables", "page.lists", F.col("page.final_url"), depth.alias("depth"), F.col("page.errors"),
    )
    return df.select(
        F.col("page.url").alias("url"), F.coalesce("page.title", F.lit("")).alias("title"), F.col("page.text").alias("text"), F.col("page.links").alias("links"),
        F.to_json(details, {"ignoreNullFields": "false"}).alias("metadata"), crawled_at.cast("timestamp").alias("crawled_at"),
        F.col("status").cast("int").alias("status_code"), F.coalesce("content_type", F.lit("")).alias("content_type"),
    )


def summary(df: DataFrame, preview: int = 200) -> DataFrame:
    """Counts and previews of parsed pages: links within the host and to others, images, headings, tables, lists."""
    df = df.withColumn("__own", urls.host(urls.normalized(F.col("page.final_url"))))
    inner = F.size(F.filter("page.links", lambda x: urls.host(x) == F.col("__own")))
    total = F.size("page.links")
    text = F.col("page.text")
    return df.select(
        F.col("page.url").alias("url"), F.col("page.title").alias("title"), F.length(text).alias("text_length"),
        F.when(F.length(text) > preview, F.concat(F.substring(text, 1, preview), F.lit("..."))).otherwise(text).alias("preview"),
        total.alias("links"), inner.alias("internal_links"), (total - inner).alias("external_links"), F.size("page.images").alias("images"),
        F.size("page.headings").alias("headings"), F.size("page.tables").alias("tables"), F.size("page.lists").alias("lists"),
    )


def robots_verdict(header_tags: Column, meta_tags: Column) -> tuple[Column, Column]:
    """(why a page must not be kept, or null; whether its links must not be followed)."""

    def has(tags: Column, *words: str) -> Column:
        return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, words))), F.lit(False))

    reason = F.when(has(header_tags, "noindex", "none"), "noindex in X-Robots-Tag").when(has(meta_tags, "noindex", "none"), "noindex in a robots meta tag")
    return reason, has(header_tags, "nofollow", "none") | has(meta_tags, "nofollow", "none")


def canonical_duplicates(parsed_pages: DataFrame, known: DataFrame) -> DataFrame:
    """Pages (url, canonical) that are variants of another page of the crawl: known(url) holds what is pending or processed.

    Only a canonical URL that differs in the query alone counts, and only while its page is known.
    """
    served = urls.queue_form(F.col("page.final_url"))
    named = parsed_pages.select(F.col("page.url").alias("url"), F.col("page.metadata.canonical").alias("canonical"), served.alias("served")).where("canonical is not null")
    named = named.withColumn("target", urls.queue_form(F.col("canonical"))).where((F.col("target") != F.col("served")) & (F.col("target") != F.col("url")))

    def place(c: Column) -> Column:
        return F.regexp_extract(c, r"^https?://([^?#]*)", 1)

    same = named.where(place(F.col("target")) == place(F.col("served")))
    return same.join(merged(known.select(F.col("url").alias("target")).distinct()), "target", "left_semi").select("url", "canonical")
