"""The error classes of a crawl as a small dimension: kind, retries, and what they mean for a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Error classes by kind, in the order in which kinds are matched.
KINDS = {
    "TransientError": ("TransientHTTPError", "FetchTimeoutError", "RenderTimeoutError", "TransientError"),
    "PermanentError": ("PermanentHTTPError", "TooManyRedirectsError", "CertificateError", "InvalidURLError", "RobotsDisallowedError", "PageTooLargeError", "SitemapError", "PermanentError"),
    "NetworkError": ("NetworkError", "DNSError", "ProxyNetworkError"),
    "ParseError": ("ParseError",),
}
OTHER = "other"
TRANSIENT_STATUS = (408, 429, 500, 502, 503, 504, 520, 521, 522, 523, 524)
PROXY_ERRORS = ("ProxyNetworkError", "NoProxyError")


def kind(error_class: Column) -> Column:
    """The kind of an error class; null for none."""
    found = F.when(error_class.isNull(), F.lit(None))
    for name, classes in KINDS.items():
        found = found.when(error_class.isin(*classes), name)
    return found.otherwise(OTHER)


def http_error_class(status: Column) -> Column:
    """TransientHTTPError, PermanentHTTPError, or null below 400."""
    return F.when(status.isin(*TRANSIENT_STATUS), "TransientHTTPError").when(status >= 400, "PermanentHTTPError")


def is_failure(error_class: Column, status: Column) -> Column:
    """Whether an outcome counts against its host: true, false, or null (neither way)."""
    return (
        F.when(error_class.isin(*PROXY_ERRORS) | (error_class == "RenderTimeoutError"), F.lit(None).cast("boolean"))
        .when(error_class.endswith("HTTPError") & (status == 429), F.lit(None).cast("boolean"))
        .when(kind(error_class).isin("TransientError", "NetworkError"), True)
        .when(error_class.endswith("HTTPError"), status >= 500)
        .when(error_class.isNull(), False)
    )


def signals_overload(error_class: Column, status: Column, retry_after: Column) -> Column:
    """429, a wait that the host asks for, or a fetch that timed out."""
    return F.coalesce((status == 429) | (retry_after > 0) | (error_class == "FetchTimeoutError"), F.lit(False))


def outwaits_retries(error_class: Column, retry_after: Column, max_delay: float) -> Column:
    """A passing HTTP error whose Retry-After is longer than retries wait."""
    return F.coalesce((error_class == "TransientHTTPError") & (retry_after > max_delay), F.lit(False))


def dimension(spark: SparkSession) -> DataFrame:
    rows = [(c, k, k in ("TransientError", "NetworkError")) for k, classes in KINDS.items() for c in classes]
    rows += [(c, OTHER, False) for c in ("CrawlerClosedError", "RobotsUnreachableError", "CircuitOpenError", "HostHeldBackError", "NoProxyError", "RenderError", "UnexpectedError")]
    return spark.createDataFrame(rows, "error_class string, kind string, retried boolean")
