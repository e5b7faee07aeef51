"""Which URLs a crawl follows: length, host scope, extensions and patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls

HTML_TYPES = ("text/html", "application/xhtml+xml")


def is_html_content_type(content_type: Column) -> Column:
    """Whether a media type is HTML's; unknown (null) counts as such."""
    return F.coalesce(F.lower(F.trim(F.element_at(F.split(content_type, ";"), 1))).isin(*HTML_TYPES), F.lit(True))


def clean_extensions(extensions: Iterable[str]) -> tuple[str, ...]:
    """Extensions as they are compared; one with an inner dot, a slash or nothing in it is refused."""
    if isinstance(extensions, str):
        raise TypeError(f"a list of extensions is wanted, not {extensions!r}")
    out = tuple(dict.fromkeys(e.strip().lower().removeprefix(".") for e in extensions))
    for e in out:
        if not e or set(e) & {"/", "."}:
            raise ValueError(f"{e!r} isn't one extension such as 'pdf'")
    return out


def clean_patterns(patterns: Iterable[str]) -> tuple[str, ...]:
    if isinstance(patterns, str):
        raise TypeError(f"a list of patterns is wanted, not {patterns!r}")
    for p in (patterns := tuple(patterns)):
        try:
            re.compile(p)
        except re.error as error:
            raise ValueError(f"invalid pattern {p!r}: {error}") from error
    return patterns


#: Syntax that Java and Python read alike; other patterns run in Python.
_PORTABLE = re.compile(r"(?:[A-Za-z0-9/:.?&=%_^$*+|()\[\]~,@!-]|\\[./?*+$^()|\[\]-])*")


def matches_any(patterns: Iterable[str], forms: list[Column]) -> Column:
    """Whether any pattern is found in any form of a URL."""
    found = F.lit(False)
    hard = []
    for p in patterns:
        if _PORTABLE.fullmatch(p) and "(?" not in p and "[[" not in p and "&&" not in p:
            for f in forms:
                found = found | f.rlike(p)
        else:
            hard.append(p)
    if hard:
        compiled = re.compile("|".join(f"(?:{p})" for p in hard)) if not any("(?P" in p or re.search(r"\\[0-9]|\(\?[a-zA-Z]", p) for p in hard) else None

        @F.pandas_udf("boolean")
        def searched(texts: pd.Series) -> pd.Series:
            ways = [compiled] if compiled else [re.compile(p) for p in hard]
            return texts.map(lambda t: t is not None and any(w.search(t) for w in ways))

        for f in forms:
            found = found | searched(f)
    return found


def unquoted(url: Column) -> Column:
    """The URL with escapes decoded; broken ones stay."""
    return F.when(url.contains("%"), F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)).otherwise(url)


@dataclass(frozen=True)
class UrlFilter:
    """A conjunction over canonical URLs; None and empty lists don't restrict.

    Hosts are in scope with their www. form and subdomains. allowed_hosts may be a frame (host) for scopes of
    any size: it is joined on the suffixes of a URL's host.
    """

    allowed_hosts: tuple[str, ...] | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    max_length: int | None = None
    scope: DataFrame | None = field(default=None, compare=False)

    def __post_init__(self):
        if self.max_length is not None and self.max_length < 1:
            raise ValueError("max_length has to be 1 or more")
        object.__setattr__(self, "include", clean_patterns(self.include))
        object.__setattr__(self, "exclude", clean_patterns(self.exclude))
        object.__setattr__(self, "extensions", clean_extensions(self.extensions))

    def condition(self, url: Column) -> Column:
        """All but the host scope."""
        forms = [url, unquoted(url)]
        ok = url.isNotNull()
        if self.max_length is not None:
            ok = ok & (F.length(url) <= self.max_length)
        if self.extensions:
            ok = ok & ~urls.extension(url).isin(*self.extensions)
        if self.exclude:
            ok = ok & ~matches_any(self.exclude, forms)
        if self.include:
            ok = ok & matches_any(self.include, forms)
        return ok

    def apply(self, df: DataFrame, url: str = "url") -> DataFrame:
        """The rows of df whose URL passes."""
        df = df.where(self.condition(F.col(url)))
        if self.scope is not None:
            return in_scope(df, self.scope, url)
        if self.allowed_hosts is None:
            return df
        if not self.allowed_hosts:
            return df.where(F.lit(False))
        spark = df.sparkSession
        return in_scope(df, spark.createDataFrame([(h,) for h in self.allowed_hosts], "host string"), url)


def suffixes(site: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(site, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def in_scope(df: DataFrame, hosts: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose host's site is that of one of hosts(host), or below it.

    Each distinct host is judged once, then rows are joined semi on it.
    """
    sites = hosts.select(urls.site(F.col("host")).alias("__site")).distinct()
    marked = df.withColumn("__host", urls.host(F.col(url)))
    known = marked.select("__host").where("__host is not null").distinct().withColumn("__site", F.explode(suffixes(urls.site(F.col("__host")))))
    allowed = known.join(sites, "__site", "left_semi").select("__host").distinct()
    return marked.join(allowed, "__host", "left_semi").drop("__host")
