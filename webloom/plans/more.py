"""More queries over the driver's tables: robots verdicts, sitemaps, charsets, retries, frontier steps, proxies, cookies, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import charset, session, text, urls
from webloom.operators import errors, frontier, jobs, politeness, robots, sitemaps, stats
from webloom.plans import crawl
from webloom.plans.catalog import _FP, _HOST, _REQ, _frontier_pages, _pages, _requests, query, table

# robots.txt: one text for all hosts; the SQL applies its rules by hand

_ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /*page=\nDisallow: /en/\nAllow: /en/*.html$\nCrawl-delay: 4\nSitemap: /map.xml\n"
_TARGET = r"regexp_extract(regexp_replace(url, '#.*$', ''), '^https?://[^/?]*(.*)$', 1)"
#: Lengths of the rules' paths: 7, 4 and 11.
_ALLOWED = f"CASE WHEN regexp_matches({_TARGET}, '^/en/.*\\.html$') THEN true WHEN regexp_matches({_TARGET}, '^/.*page=') THEN false WHEN {_TARGET} LIKE '/en/%' THEN false ELSE true END"


def _downloads(spark, sf_dir, status=None, error=None) -> DataFrame:
    origins = _pages(spark, sf_dir).select(urls.origin(F.col("canonical")).alias("origin")).distinct()
    none = F.lit(None).cast("string")
    return origins.select("origin", (F.lit(200) if status is None else status).alias("status"), F.lit(_ROBOTS).alias("text"), (none if error is None else error).alias("error_class"))


@query(f"SELECT page_id, {_ALLOWED} AS allowed, CAST(4 AS DOUBLE) AS crawl_delay FROM pages")
def robots_verdicts(spark, sf_dir):
    rules = robots.read_rules(_downloads(spark, sf_dir))
    return robots.verdicts(_pages(spark, sf_dir), rules, "ourbot/1.0", "canonical").select("page_id", "allowed", "crawl_delay")


_ORIGIN_N = "length(regexp_extract(url, '^https?://[^/?#]*', 0)) % 4"


@query(f"SELECT page_id, CASE {_ORIGIN_N} WHEN 0 THEN {_ALLOWED} WHEN 1 THEN true ELSE false END AS allowed FROM pages")
def robots_unreachable(spark, sf_dir):
    n = F.length("origin") % 4
    rules = robots.read_rules(_downloads(spark, sf_dir, F.when(n == 0, 200).when(n == 1, 404).when(n == 2, 503), F.when(n == 3, "NetworkError")))
    return robots.verdicts(_pages(spark, sf_dir), rules, "ourbot/1.0", "canonical").select("page_id", "allowed")


@query("SELECT DISTINCT regexp_extract(url, '^https?://[^/?#]*', 0) AS origin, g AS group_id, a AS allow, p AS path FROM pages, (VALUES (0, false, '/'), (1, false, '/*page='), (1, false, '/en/'), (1, true, '/en/*.html$')) v(g, a, p)")
def robots_rows(spark, sf_dir):
    return robots.as_rows(robots.read_rules(_downloads(spark, sf_dir))).select("origin", "group_id", "allow", "path")


# Sitemaps: one file a host, made of its pages


def _maps(spark, sf_dir) -> DataFrame:
    p = _pages(spark, sf_dir).select("page_id", urls.host(F.col("canonical")).alias("host"), "canonical")
    listed = p.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("page_id", "canonical"))).alias("all"))
    loc = F.transform("all", lambda x: F.concat(F.lit("<url><loc> "), F.replace(x["canonical"], F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>")))
    body = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(loc, "\n"), F.lit("</urlset>"))
    return listed.select(F.concat(F.lit("https://"), "host", F.lit("/map.xml")).alias("url"), body.cast("binary").alias("body"))


_BARE = "regexp_replace(url, '#.*$', '')"


@query(f"SELECT root, url, CAST(row_number() OVER (PARTITION BY root ORDER BY first) - 1 AS INTEGER) AS pos FROM (SELECT 'https://' || {_HOST} || '/map.xml' AS root, {_BARE} AS url, min(page_id) AS first FROM pages GROUP BY 1, 2)")
def sitemap_pages(spark, sf_dir):
    files = _maps(spark, sf_dir)
    return sitemaps.expand(files, files.select("url"))


@query(f"SELECT {_HOST} AS host, count(*) AS locations FROM pages GROUP BY 1")
def sitemap_locations(spark, sf_dir):
    files = _maps(spark, sf_dir)
    return files.select(F.regexp_extract("url", "https://([^/]*)", 1).alias("host"), F.size(sitemaps.locations(F.col("body").cast("string"))).cast("long").alias("locations"))


# Charsets


@query("SELECT doc_id, coalesce(text, '') AS decoded FROM documents")
def charset_decode(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    body = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "UTF-16BE"))
    kind = F.when(F.col("doc_id") % 2 == 0, "text/html; charset=utf-8").otherwise("text/html; charset=utf-16-be")
    return d.select("doc_id", charset.decoded(kind, body).alias("decoded"))


# Retries, timeouts, errors


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 90 AS DOUBLE) WHEN o_orderkey % 3 = 1 THEN greatest(0.0, CAST(epoch(date_trunc('second', o_orderdate)) AS DOUBLE) - 1700000000) END AS seconds FROM orders")
def retry_after_header(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey") % 3
    date = F.date_format(F.col("o_orderdate").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(n == 0, (F.col("o_orderkey") % 90).cast("string")).when(n == 1, date).otherwise("soon")
    return o.select("o_orderkey", politeness.retry_after(header, F.lit(1_700_000_000.0)).alias("seconds"))


_ATTEMPT = "(SELECT event_id, event_id % 5 AS retries, CASE event_id % 6 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 404 WHEN 3 THEN 503 END AS status, CASE event_id % 6 WHEN 2 THEN 'PermanentHTTPError' WHEN 4 THEN 'NetworkError' WHEN 5 THEN 'ParseError' ELSE 'TransientHTTPError' END AS error FROM events)"


def _attempts(spark, sf_dir) -> DataFrame:
    n = F.col("event_id") % 6
    status = F.when(n == 0, 429).when(n == 1, 500).when(n == 2, 404).when(n == 3, 503)
    error = F.when(n == 2, "PermanentHTTPError").when(n == 4, "NetworkError").when(n == 5, "ParseError").otherwise("TransientHTTPError")
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5).alias("retries"), status.alias("status"), error.alias("error"))


@query(f"SELECT event_id, error IN ('TransientHTTPError', 'NetworkError') AND retries < 3 AND NOT (coalesce(status, 0) = 500 AND retries >= 1) AS retried FROM {_ATTEMPT}")
def retry_decisions(spark, sf_dir):
    none = F.lit(None).cast("double")
    why = politeness.RetryPolicy().refusal(F.col("error"), F.col("status"), F.col("retries"), F.col("retries"), none)
    return _attempts(spark, sf_dir).select("event_id", why.isNull().alias("retried"))


@query(f"SELECT event_id, least(pow(1.5, retries), 4.0) * CASE WHEN event_id % 7 = 0 THEN 100.0 ELSE 10.0 END AS seconds FROM {_ATTEMPT}")
def timeout_growth(spark, sf_dir):
    return _attempts(spark, sf_dir).select("event_id", politeness.timeout_for(F.lit(10.0), F.col("retries"), 1.5, F.col("event_id") % 7 == 0).alias("seconds"))


@query(f"SELECT event_id, CASE WHEN status = 429 THEN 'neither' WHEN status IN (500, 503) OR error = 'NetworkError' THEN 'true' WHEN status = 404 THEN 'false' ELSE 'neither' END AS failed, coalesce(status = 429, false) AS overload FROM {_ATTEMPT}")
def failure_verdicts(spark, sf_dir):
    none = F.lit(None).cast("double")
    return _attempts(spark, sf_dir).select("event_id", F.coalesce(errors.is_failure(F.col("error"), F.col("status")).cast("string"), F.lit("neither")).alias("failed"), errors.signals_overload(F.col("error"), F.col("status"), none).alias("overload"))


@query("SELECT conv_id AS url, 'NetworkError' AS error_class FROM conversations WHERE false")
def permanent_none(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return stats.permanent(c.select(F.col("conv_id").alias("url"), F.col("turn").alias("attempt"), F.lit("NetworkError").alias("error_class")))


@query("SELECT CAST(sum(last - 1) AS BIGINT) AS retries, count(*) FILTER (WHERE last > 1 AND last % 2 = 1) AS recovered, 1.5 AS avg_retry_seconds FROM (SELECT conv_id, max(n) AS last FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY 1)")
def retries_recovered(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("url"), n.alias("attempt"))
    return stats.retries(c.withColumn("error_class", F.when(F.col("attempt") % 2 == 0, "NetworkError")).withColumn("waited", F.lit(1.5)))


# Frontier steps


_PLACED = f"(SELECT 'https://h' || host || '.example/' || position AS url, 'h' || host || '.example' AS host, position AS seq FROM {_FP})"


def _placed(spark, sf_dir) -> DataFrame:
    p = _frontier_pages(spark, sf_dir)
    return p.select(F.concat(F.lit("https://h"), "host", F.lit(".example/"), F.col("position").cast("string")).alias("url"), F.concat(F.lit("h"), "host", F.lit(".example")).alias("host"), F.lit(0).alias("depth"), F.col("position").alias("seq"))


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq) <= 5 AS fits FROM {_PLACED}), c AS (SELECT *, sum(CASE WHEN fits THEN 1 ELSE 0 END) OVER (ORDER BY seq) - CASE WHEN fits THEN 1 ELSE 0 END AS before FROM r) SELECT CASE WHEN before >= 300 THEN 'over_limit' WHEN NOT fits THEN 'over_host_limit' ELSE 'admitted' END AS admission, count(*) AS pages FROM c GROUP BY 1")
def admit_limits(spark, sf_dir):
    return frontier.admit(_placed(spark, sf_dir), 300, 5).groupBy("admission").agg(F.count(F.lit(1)).alias("pages"))


@query(f"SELECT url, host FROM {_PLACED} WHERE seq % 3 <> 0")
def add_new_links(spark, sf_dir):
    p = _placed(spark, sf_dir)
    rows, _ = frontier.add(frontier.new_rows(p.where("seq % 3 = 0")), p.select("url", F.col("seq").alias("position")), 1)
    return rows.select("url", "host")


@query(f"SELECT url, CASE WHEN seq % 4 = 0 THEN 'queued' WHEN seq % 4 = 1 AND seq % 8 = 1 THEN 'failed' WHEN seq % 4 = 1 THEN 'queued' ELSE 'leased' END AS state FROM {_PLACED}")
def reclaim_leases(spark, sf_dir):
    f = frontier.new_rows(_placed(spark, sf_dir), "leased").withColumn("lease_until", F.when(F.col("seq") % 4 < 2, 5.0).otherwise(50.0)).withColumn("attempts", F.when(F.col("seq") % 8 == 1, 2).otherwise(0))
    return frontier.reclaim(f, 10.0).select("url", "state")


@query(f"SELECT url, CASE seq % 4 WHEN 0 THEN 'processed' WHEN 1 THEN 'failed' WHEN 2 THEN 'saving' ELSE 'leased' END AS state, CASE WHEN seq % 4 < 2 THEN 7.0 END AS finished_at FROM {_PLACED}")
def finish_outcomes(spark, sf_dir):
    p = _placed(spark, sf_dir)
    done = p.where("seq % 4 < 3").select("url", F.when(F.col("seq") % 4 == 1, "failed").otherwise("processed").alias("outcome"), (F.col("seq") % 4 == 2).alias("pending_save"))
    return frontier.finish(frontier.new_rows(p, "leased"), done, 7.0).select("url", "state", "finished_at")


@query(f"SELECT url, CASE WHEN seq % 5 = 0 THEN m + row_number() OVER (PARTITION BY seq % 5 = 0 ORDER BY url) ELSE seq END AS seq FROM {_PLACED}, (SELECT max(seq) AS m FROM {_PLACED})")
def put_back_behind(spark, sf_dir):
    p = _placed(spark, sf_dir)
    return frontier.put_back(frontier.new_rows(p, "leased"), p.where("seq % 5 = 0").select("url"), 0.0).select("url", "seq")


@query(f"SELECT url, CASE WHEN host IN ('h1.example', 'h2.example') THEN 'unreachable' ELSE 'queued' END AS state FROM {_PLACED}")
def give_up_hosts(spark, sf_dir):
    hosts = spark.createDataFrame([(f"h{i}.example", "unreachable", "given up", "NetworkError") for i in (1, 2)], "host string, outcome string, reason string, error string")
    return frontier.give_up_hosts(frontier.new_rows(_placed(spark, sf_dir)), hosts, 1.0).select("url", "state")


@query("WITH RECURSIVE t AS (SELECT 1::BIGINT AS n, 0 AS depth UNION ALL SELECT o_orderkey, depth + 1 FROM t JOIN orders ON o_orderkey IN (n * 2, n * 2 + 1)) SELECT depth, count(*) AS pages FROM t GROUP BY 1")
def graph_depths(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    edges = keys.where("o_orderkey > 1").select(F.expr("o_orderkey div 2").cast("string").alias("src"), F.col("o_orderkey").cast("string").alias("dst"))
    roots = spark.createDataFrame([("1",)], "url string")
    return crawl.graph_depths(edges, roots, 40).groupBy("depth").agg(F.count(F.lit(1)).alias("pages"))


_OSTATE = "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'processed' ELSE 'failed' END"


@query(f"SELECT count(*) FILTER (WHERE s = 'processed') AS successful, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'queued') AS queued, round(avg(CASE WHEN s <> 'queued' THEN o_totalprice END), 4) AS avg_response_time FROM (SELECT {_OSTATE} AS s, o_totalprice FROM orders)")
def job_totals(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "processed").otherwise("failed")
    f = table(spark, sf_dir, "orders").select(state.alias("state"), F.col("o_totalprice").alias("elapsed"))
    return jobs.page_totals(f).select("successful", "failed", "queued", F.round("avg_response_time", 4).alias("avg_response_time"))


# Hosts, proxies, rates


@query(f"SELECT count(*) AS requests, round(count(*) FILTER (WHERE t > 1706700000 - 5 AND t <= 1706700000) / 5.0, 6) AS current_rps, round(avg(gap), 4) AS avg_delay FROM (SELECT epoch_us(ts) / 1e6 AS t, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY host ORDER BY ts) AS gap FROM {_REQ})")
def rate_totals(spark, sf_dir):
    r = _requests(spark, sf_dir).withColumn("start", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return politeness.rate_stats(r, 1_706_700_000.0, 0.0).select("requests", F.round("current_rps", 6).alias("current_rps"), F.round("avg_delay", 4).alias("avg_delay"))


@query(f"SELECT host, max(epoch_us(ts) / 1e6 + elapsed) AS next_allowed_at, max(elapsed) AS interval FROM {_REQ} GROUP BY 1")
def holds_and_delays(spark, sf_dir):
    r = _requests(spark, sf_dir).select("host", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("elapsed").alias("seconds"), F.lit("429").alias("reason"))
    held = politeness.holds(r).select("host", "next_allowed_at")
    return held.join(politeness.crawl_delays(r.withColumn("delay", F.col("seconds"))), "host").select("host", "next_allowed_at", "interval")


@query(f"""WITH r AS (SELECT host % 4 AS proxy, event_id, error IS NOT NULL AS failed FROM {_REQ}),
b AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY proxy ORDER BY event_id) AS block FROM r),
n AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY proxy, block ORDER BY event_id) AS run FROM b)
SELECT proxy, count(*) AS requests, count(*) FILTER (WHERE failed) AS failures, count(*) FILTER (WHERE failed AND run % 3 = 0) AS times_removed FROM n GROUP BY 1""")
def proxy_removals(spark, sf_dir):
    r = _requests(spark, sf_dir).select((F.col("host") % 4).alias("proxy"), F.col("event_id").alias("t"), F.col("error").isNotNull().alias("failed"))
    return politeness.proxy_stats(r)


@query(f"""WITH m AS (SELECT host, epoch_us(ts) AS moment, 1 AS step FROM {_REQ} UNION ALL SELECT host, epoch_us(ts) + 86400000000, -1 FROM {_REQ}),
a AS (SELECT host, sum(step) OVER (PARTITION BY host ORDER BY moment, step ROWS UNBOUNDED PRECEDING) AS active FROM m) SELECT host, CAST(max(active) AS BIGINT) AS most FROM a GROUP BY 1""")
def active_requests(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return politeness.active_at_once(_requests(spark, sf_dir).select("host", at.alias("start"), (at + 86_400_000_000).alias("stop")))


# Cookies and cells


@query("SELECT 'c' || c_custkey AS name, CASE WHEN c_custkey % 5 = 0 THEN 'new' WHEN c_custkey % 5 = 1 THEN 'changed' ELSE 'removed' END AS change FROM customer WHERE c_custkey % 5 < 3")
def cookie_changes(spark, sf_dir):
    n = F.col("c_custkey") % 5
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit("shop.example").alias("host"), F.lit(False).alias("subdomains"), F.lit("/").alias("path"), F.lit(True).alias("secure"), F.lit(9e9).alias("expires"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_mktsegment").alias("value"), F.lit(False).alias("http_only"),
    )
    now = c.where(n != 2).withColumn("value", F.when(n == 1, "other").otherwise(F.col("value")))
    changed, removed = session.cookie_changes(c.where(n != 0).drop("c_custkey"), now)
    kept = changed.select("name", F.when(F.col("c_custkey") % 5 == 0, "new").otherwise("changed").alias("change"))
    return kept.unionByName(removed.select("name", F.lit("removed").alias("change")))


@query("SELECT doc_id, text AS cell FROM documents")
def csv_formula_roundtrip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.unescaped_formula(text.escaped_formula(F.col("text"))).alias("cell"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024.0) ELSE printf('%.1f MB', n_chars / 1048576.0) END AS size, CASE WHEN length(text) <= 48 THEN text ELSE left(text, 47) || '…' END AS label FROM documents WHERE n_chars IS NOT NULL")
def report_cells(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("n_chars is not null").select("doc_id", text.byte_size(F.col("n_chars")).alias("size"), text.shortened(F.col("text")).alias("label"))


@query("SELECT o_orderkey, '[' || repeat('#', p * 20 // 100) || repeat('-', 20 - p * 20 // 100) || '] ' || lpad(CAST(p AS VARCHAR), 3, ' ') || '%' AS bar FROM (SELECT o_orderkey, CAST(o_orderkey % 101 AS INTEGER) AS p FROM orders)")
def progress_bars(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.progress_bar(F.col("o_orderkey") % 101).alias("bar"))


@query("SELECT page_id, 'http://u@h.example/' || page_id AS kept, 'http://h.example/' || page_id AS bare FROM pages")
def url_userinfo(spark, sf_dir):
    c = F.concat(F.lit("http://u@H.example:80/"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", urls.normalized(c).alias("kept"), urls.without_userinfo(urls.normalized(c)).alias("bare"))
