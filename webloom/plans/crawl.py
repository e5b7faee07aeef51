"""A breadth-first crawl over a table of fetched pages: a loop over depths, each a few set operations.

A level of the frontier is admitted by (depth, seq), joined with the answers, its redirects are followed, pages are
judged in a fixed order of precedence, and their links become the next level by a bounded insert. What a
level leaves is checkpointed, so lineage doesn't grow with depth.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators import frontier, pages, robots, sitemaps
from webloom.operators.errors import http_error_class
from webloom.operators.filters import UrlFilter, is_html_content_type
from webloom.operators.order import checkpointed, merged, numbered

FETCHED = "url STRING, status INT, content_type STRING, html STRING, location STRING, robots_tag ARRAY<STRING>, error_class STRING, elapsed DOUBLE"
MAX_REDIRECTS = 10
#: So many wanted URLs are broadcast to the answers at most.
FEW = 10_000


@dataclass(frozen=True)
class CrawlPlan:
    max_pages: int = 100
    max_depth: int = 2
    max_per_host: int | None = None
    same_domain_only: bool = False
    filters: UrlFilter = field(default_factory=lambda: UrlFilter(max_length=frontier.MAX_URL_LENGTH))
    agent: str = "*"
    respect_robots: bool = True
    skip_nofollow: bool = True


def fetched(df: DataFrame) -> DataFrame:
    """df in the shape FETCHED with canonical URLs; columns that it lacks are null, a page without a status is 200 HTML."""
    defaults = {"status": F.lit(200), "content_type": F.lit("text/html")}
    columns = []
    for spec in FETCHED.split(", "):
        name, kind = spec.split(" ")
        c = F.col(name) if name in df.columns else defaults.get(name, F.lit(None))
        columns.append(c.cast(kind).alias(name))
    shaped = df.select(*columns).withColumn("url", urls.normalized(F.col("url"))).where("url is not null")
    # of several answers to a URL, one with a status before others, then the least by its fields: the same on every run
    return shaped.groupBy("url").agg(F.min_by(F.struct(*shaped.columns), F.struct(F.col("status").isNull(), *shaped.columns)).alias("r")).select("r.*")


def follow_redirects(wanted: DataFrame, answers: DataFrame, hops: int = MAX_REDIRECTS) -> DataFrame:
    """wanted(url) with final_url and the last answer's fields; chains longer than `hops` end in TooManyRedirectsError.

    The loop ends with the longest chain; only rows still on their way are joined again.
    """
    rest = [c for c in answers.columns if c != "url"]
    target = F.when(F.col("status").isin(301, 302, 303, 307, 308) & F.col("location").isNotNull(), urls.resolved(F.col("location"), F.col("final_url")))
    moving = wanted.select("url", F.col("url").alias("final_url"))
    done, n = None, moving.count()
    for hop in range(hops + 1):
        asked = moving.select("final_url").distinct()
        found = answers.withColumnRenamed("url", "final_url").join(merged(asked) if n > FEW else F.broadcast(asked), "final_url", "left_semi")
        met = moving.join(merged(found), "final_url", "left").withColumn("__to", target)
        met = checkpointed(met)
        stay = met.where("__to is null").drop("__to").select("url", "final_url", *rest)
        done = stay if done is None else done.unionByName(stay)
        moving = met.where("__to is not null").select("url", F.col("__to").alias("final_url"))
        n = moving.count()
        if not n:
            return done
        if hop == hops:
            lost = moving.select("url", "final_url", *[F.lit(None).cast(answers.schema[c].dataType).alias(c) for c in rest]).withColumn("error_class", F.lit("TooManyRedirectsError"))
            return done.unionByName(lost)
    return done


def outcome(allowed: Column, in_scope: Column) -> tuple[Column, Column, Column]:
    """(outcome, reason, error) of an answered page; the first that holds."""
    missing = F.col("status").isNull() & F.col("error_class").isNull()
    http = http_error_class(F.col("status"))
    cases = [
        (~allowed, "blocked", F.lit("disallowed by robots.txt"), F.lit(None).cast("string")),
        (missing, "failed", F.lit("no answer"), F.lit("NetworkError")),
        (F.col("error_class").isNotNull(), "failed", F.col("error_class"), F.col("error_class")),
        (http.isNotNull(), "failed", F.concat(F.lit("HTTP "), F.col("status").cast("string")), http),
        (~in_scope, "skipped", F.concat(F.lit("redirected out of scope: "), F.col("final_url")), F.lit(None).cast("string")),
        (F.col("met_before"), "skipped", F.concat(F.lit("leads to a page of the crawl: "), F.col("final_url")), F.lit(None).cast("string")),
        (~is_html_content_type(F.col("content_type")), "skipped", F.concat(F.lit("not HTML: "), F.col("content_type")), F.lit(None).cast("string")),
        (F.col("page.problem").isNotNull(), "failed", F.col("page.problem"), F.lit("ParseError")),
        (F.col("duplicate_of").isNotNull(), "skipped", F.concat(F.lit("duplicate of "), F.col("duplicate_of")), F.lit(None).cast("string")),
        (F.col("noindex").isNotNull(), "skipped", F.col("noindex"), F.lit(None).cast("string")),
    ]
    state, reason, error = F.lit("processed"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for hit, s, r, e in reversed(cases):
        state, reason, error = F.when(hit, s).otherwise(state), F.when(hit, r).otherwise(reason), F.when(hit, e).otherwise(error)
    return state, reason, error


def crawl(spark: SparkSession, start_urls: list[str], answers: DataFrame, plan: CrawlPlan = CrawlPlan(), rules: DataFrame | None = None, listed: DataFrame | None = None, roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(frontier, parsed pages) of a crawl from start_urls over answers (see fetched()); rules as robots.read_rules() makes them.

    listed(url, body) are downloaded sitemaps and roots(url) those to begin with: the pages that they list, in order and as far as
    the filters allow, are queued behind the start URLs at depth 0. A page is crawled under one URL: a redirect to
    a page that the crawl knows, or that another page has led to, is not followed up.
    """
    answers = checkpointed(fetched(answers))  # read again at each level and hop
    filters = plan.filters
    if plan.same_domain_only:
        filters = UrlFilter(tuple(h for h in map(urls.host_of, start_urls) if h), filters.include, filters.exclude, filters.extensions, filters.max_length)
    seeds = spark.createDataFrame([(u, i) for i, u in enumerate(start_urls)], "url string, position long")
    rows = frontier.candidates(seeds).withColumn("depth", F.lit(0)).withColumn("seq", F.col("position"))
    state = checkpointed(frontier.new_rows(rows))
    if listed is not None and roots is not None:
        found = sitemaps.expand(listed, roots)
        allowed = numbered(filters.apply(found, "url"), "position", "root", "pos").select("url", "position")
        more, _ = frontier.add(state, allowed, 0, plan.max_pages, plan.max_per_host)
        state = checkpointed(state.unionByName(more))
    parsed_all = None
    for depth in range(plan.max_depth + 1):
        level = state.where(F.col("depth") == depth)
        counted = state.where("counted")
        judged = frontier.admit(level.where("state = 'queued'"), plan.max_pages, plan.max_per_host, counted.count(), counted.groupBy("host").agg(F.count(F.lit(1)).alias("requested")))
        taken = checkpointed(judged.where("admission = 'admitted'").select("url", "host", "depth", "seq"))
        if taken.isEmpty():
            break
        got = follow_redirects(taken, answers)
        if rules is not None and plan.respect_robots:
            got = robots.verdicts(got, rules, plan.agent)
        else:
            got = got.withColumn("allowed", F.lit(True))
        scope = filters.apply(got.select("final_url").distinct(), "final_url").withColumn("__in", F.lit(True))
        got = got.join(merged(scope), "final_url", "left").withColumn("in_scope", F.coalesce("__in", F.lit(False)) | (F.lit(depth) == 0)).drop("__in")
        moved = got.where("final_url != url").select(urls.queue_form(F.col("final_url")).alias("to"), "url").where("to != url")
        seen, may = frontier.mark_seen(state, moved.select(F.col("to").alias("url"), F.col("url").alias("source")))
        barred = may.where("not may_follow").select(F.col("source").alias("url"), F.lit(True).alias("met_before"))
        got = got.join(merged(barred), "url", "left").withColumn("met_before", F.coalesce("met_before", F.lit(False)))
        got = got.withColumn("page", pages.parsed(F.when(F.col("allowed"), F.col("html")), F.col("url"), F.col("final_url"), skip_nofollow=plan.skip_nofollow))
        got = checkpointed(got)
        known = state.where(F.col("state").isin("queued", "leased", "processed")).select("url")
        twins = pages.canonical_duplicates(got.where("page.problem is null"), known).withColumnRenamed("canonical", "duplicate_of")
        noindex, nofollow = pages.robots_verdict(F.col("robots_tag"), F.col("page.metadata.robots"))
        nothing = F.lit(None).cast("string")
        got = got.join(merged(twins), "url", "left").withColumn("noindex", noindex if plan.respect_robots else nothing).withColumn("nofollow", nofollow if plan.respect_robots else F.lit(False))
        s, r, e = outcome(F.col("allowed"), F.col("in_scope"))
        got = checkpointed(got.withColumns({"outcome": s, "reason": r, "error": e}))
        results = got.select("url", "outcome", "reason", "status", "elapsed", "error", (~F.col("outcome").isin("blocked", "unreachable")).alias("counts"))
        state = frontier.finish(state, results, float(depth + 1))
        state = state.join(merged(results.where("counts").select("url", F.lit(True).alias("__c"))), "url", "left").withColumn("counted", F.col("counted") | F.coalesce("__c", F.lit(False))).drop("__c")
        # what a page that failed has led to may be queued by others
        kept = seen.join(merged(got.where("outcome != 'failed'").select(F.col("url").alias("seen_from"))), "seen_from", "left_semi")
        state = state.unionByName(kept.select(*state.columns))
        if plan.max_per_host is not None:
            over = judged.where("admission = 'over_host_limit'").select("url", F.lit("skipped").alias("outcome"), F.lit("over max_pages_per_host").alias("reason"))
            state = frontier.finish(state, over, float(depth + 1))
        state = checkpointed(state)
        found = got.where("outcome = 'processed'")
        parsed_all = found if parsed_all is None else parsed_all.unionByName(found)
        if depth < plan.max_depth:
            linking = got.where(F.col("outcome").isin("processed") & ~F.col("nofollow")).select("url", F.col("page.links").alias("links")).where(F.size("links") > 0)
            out = linking.join(merged(taken.select("url", "seq")), "url").select("seq", F.posexplode("links").alias("pos", "link"))
            out = filters.apply(out.withColumnRenamed("link", "url"), "url")
            place = numbered(out, "position", "seq", "pos").select("url", "position")
            rows, _ = frontier.add(state, place, depth + 1, plan.max_pages, plan.max_per_host)
            state = checkpointed(state.unionByName(rows))
    return state, parsed_all


def graph_depths(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth): the least number of links from a root, up to max_depth, over edges(src, dst)."""
    level = checkpointed(roots.select("url").distinct().withColumn("depth", F.lit(0)))
    seen = level
    for d in range(1, max_depth + 1):
        reached = level.join(edges, level.url == edges.src).select(F.col("dst").alias("url")).distinct()
        level = checkpointed(reached.join(seen, "url", "left_anti").withColumn("depth", F.lit(d)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen
