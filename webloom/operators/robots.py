"""Verdicts of robots.txt for URLs, as an equi-join on the origin with the rule's pattern beside it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import robotstxt, urls
from webloom.functions.udfs import arrow_udf

_PARSED = (
    "groups ARRAY<STRUCT<agents: ARRAY<STRING>, rules: ARRAY<STRUCT<allow: BOOLEAN, path: STRING, pattern: STRING>>, delay: DOUBLE>>, sitemaps ARRAY<STRING>"
)


@arrow_udf(_PARSED)
def _parsed(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([robotstxt.parse_robots(t) for t in texts], columns=["groups", "sitemaps"])


def outcome(status: Column, error_class: Column) -> tuple[Column, Column]:
    """(why everything is forbidden, or null; whether a later download may help) of a robots.txt download."""
    permanent = error_class.isin("CertificateError", "InvalidURLError", "RobotsDisallowedError", "PageTooLargeError", "PermanentHTTPError", "DNSError")
    failed = error_class.isNotNull() & (error_class != "TooManyRedirectsError")
    reason = F.when(failed, error_class).when(error_class.isNull() & ((status == 429) | (status >= 500)), F.concat(F.lit("HTTP "), status.cast("string")))
    return reason, ~(failed & permanent)


def read_rules(downloads: DataFrame) -> DataFrame:
    """downloads(origin, status, text, error_class) -> origin, groups, sitemaps, unreachable, recoverable, ttl.

    2xx is parsed; other answers and redirect loops allow everything; 429, 5xx and errors forbid it for a minute.
    """
    reason, recoverable = outcome(F.col("status"), F.col("error_class"))
    ok = F.col("error_class").isNull() & F.col("status").between(200, 299)
    read = downloads.withColumn("rules", _parsed(F.when(ok, F.col("text"))))
    ttl = F.when(reason.isNotNull(), robotstxt.UNREACHABLE_TTL).otherwise(robotstxt.TTL)
    return read.select("origin", "rules.groups", "rules.sitemaps", reason.alias("unreachable"), recoverable.alias("recoverable"), ttl.alias("ttl"))


def rules_for(rules: DataFrame, agent: str) -> DataFrame:
    """(origin, unreachable, delay, own_rules): each origin's merged rules for the crawler: its own groups, else those for *."""
    token = robotstxt.product_token(agent)
    own = F.filter("groups", lambda g: F.array_contains(g["agents"], token)) if token else F.array()
    common = F.filter("groups", lambda g: F.array_contains(g["agents"], "*"))
    chosen = F.when(F.size(own) > 0, own).otherwise(common) if token else common
    picked = rules.withColumn("chosen", chosen)
    delay = F.array_max(F.transform("chosen", lambda g: g["delay"]))
    return picked.select("origin", "unreachable", delay.alias("delay"), F.flatten(F.transform("chosen", lambda g: g["rules"])).alias("own_rules"))


def verdicts(pages: DataFrame, rules: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """pages with allowed and crawl_delay (at most 30 s). pages' URLs are canonical; invalid ones are refused.

    The longest matching path decides, Allow wins a tie; an origin without rules allows all; /robots.txt is
    always allowed. Each page meets its origin's one row; its rules are tried inside it.
    """
    for_agent = rules_for(rules, agent).withColumnRenamed("origin", "__origin").withColumnsRenamed({"unreachable": "__unreachable", "delay": "__delay", "own_rules": "__rules"})
    target = urls.path_and_query(F.col(url))
    joined = pages.withColumn("__target", target).join(for_agent, urls.origin(F.col(url)) == F.col("__origin"), "left")
    best = F.expr("array_max(transform(filter(__rules, r -> __target rlike r.pattern), r -> struct(length(r.path) as n, r.allow as allow)))")
    allowed = (
        F.when(F.col(url).isNull(), False)
        .when(F.col("__target") == "/robots.txt", True)
        .when(F.col("__unreachable").isNotNull(), False)
        .otherwise(F.coalesce(best["allow"], F.lit(True)))
    )
    delay = F.least(F.coalesce("__delay", F.lit(0.0)), F.lit(robotstxt.MAX_DELAY))
    return joined.withColumn("allowed", allowed).withColumn("crawl_delay", delay).drop("__target", "__origin", "__unreachable", "__delay", "__rules")


def as_rows(rules: DataFrame) -> DataFrame:
    """origin, group_id, agents, allow, path, delay: a row per rule, groups in file order."""
    groups = rules.select("origin", F.posexplode("groups").alias("group_id", "g"))
    return groups.select("origin", "group_id", "g.agents", F.col("g.delay").alias("delay"), F.explode_outer("g.rules").alias("r")).select("origin", "group_id", "agents", "r.allow", "r.path", "delay")


def latest_unexpired(rules: DataFrame, now: Column, origin: str = "origin", read_at: str = "read_at") -> DataFrame:
    """The cached rules that still hold: each origin's latest download, within its time to live."""
    last = F.row_number().over(Window.partitionBy(origin).orderBy(F.col(read_at).desc()))
    return rules.withColumn("__n", last).where((F.col("__n") == 1) & (F.col(read_at) + F.col("ttl") > now)).drop("__n")


@arrow_udf("array<string>")
def _tags(values: pd.Series, agents: pd.Series) -> pd.Series:
    return pd.Series([robotstxt.tag_directives(list(v) if v is not None else [], a) for v, a in zip(values, agents, strict=True)])


def tag_directives(headers: Column, agent: str) -> Column:
    """Directives of X-Robots-Tag headers (an array) that concern the crawler."""
    return _tags(headers, F.lit(agent))
