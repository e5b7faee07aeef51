"""Answers of hosts as a table: body limits, charsets and typed errors; files of pages as a stand-in for the network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.charset import decoded
from webloom.operators.errors import http_error_class
from webloom.operators.filters import is_html_content_type

MAX_PAGE = 3 << 20
FETCH_RESULT = (
    "url STRING, elapsed DOUBLE, status INT, content STRING, size BIGINT, error_class STRING, error_message STRING, retry_after DOUBLE, "
    "final_url STRING, content_type STRING, redirected BOOLEAN, robots_tag ARRAY<STRING>"
)


def limited_body(body: Column, limit: int | None, truncate_at: int | None = None) -> tuple[Column, Column]:
    """(body, whether it is too large): cut at truncate_at, else refused beyond limit."""
    if truncate_at is not None:
        return F.substring(body, 1, truncate_at), F.lit(False)
    if limit is None:
        return body, F.lit(False)
    over = F.coalesce(F.octet_length(body) > limit, F.lit(False))
    return F.when(~over, body), over


def fetch_results(answers: DataFrame, max_page: int | None = MAX_PAGE, html_only: bool = True) -> DataFrame:
    """FETCH_RESULT rows of answers(url, status, content_type, body[, elapsed, retry_after, final_url, robots_tag, error_class]).

    Nothing raises: what went wrong is in error_class and error_message, and such rows have no content.
    """
    def given(name: str, kind: str) -> Column:
        return (F.col(name) if name in answers.columns else F.lit(None)).cast(kind)

    body, large = limited_body(F.col("body"), max_page)
    error = F.coalesce(given("error_class", "string"), http_error_class(F.col("status")), F.when(large, "PageTooLargeError"))
    message = F.when(error.endswith("HTTPError"), F.concat(F.lit("HTTP "), F.col("status").cast("string"))).when(large, F.lit(f"larger than {max_page} bytes")).otherwise(error)
    wanted = error.isNull() & (is_html_content_type(F.col("content_type")) if html_only else F.lit(True))
    final = F.coalesce(given("final_url", "string"), F.col("url"))
    return answers.select(
        "url", given("elapsed", "double").alias("elapsed"), F.col("status").cast("int").alias("status"), decoded(F.col("content_type"), F.when(wanted, body)).alias("content"), F.octet_length("body").cast("long").alias("size"),
        error.alias("error_class"), F.when(error.isNotNull(), message).alias("error_message"), given("retry_after", "double").alias("retry_after"), final.alias("final_url"), "content_type", (final != F.col("url")).alias("redirected"), given("robots_tag", "array<string>").alias("robots_tag"),
    )


def fetch_many(urls_: DataFrame, answers: DataFrame) -> DataFrame:
    """A row per asked URL(url, pos), in order of pos; unanswered ones are NetworkErrors."""
    results = fetch_results(answers)
    joined = urls_.join(results, "url", "left")
    lost = F.col("status").isNull() & F.col("error_class").isNull()
    return joined.withColumn("error_class", F.when(lost, "NetworkError").otherwise(F.col("error_class"))).withColumn("error_message", F.when(lost, "no answer").otherwise(F.col("error_message"))).orderBy("pos")


def bodies(results: DataFrame) -> DataFrame:
    """url and content of what succeeded."""
    return results.where("error_class is null and content is not null").select("url", "content")


def render_stats(results: DataFrame) -> DataFrame:
    """Counts by what a renderer did (column render_state) and the mean time of rendered pages."""
    state = F.col("render_state")
    return results.agg(F.count_if(state == "rendered").alias("rendered"), F.count_if(state == "failed").alias("failed"), F.count_if(state == "unrendered").alias("unrendered"), F.avg(F.when(state == "rendered", F.col("render_seconds"))).alias("avg_render_seconds"))
