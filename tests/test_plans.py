import json
import time

import pytest
from pyspark.sql import functions as F

from webloom import config, report
from webloom.plans import crawl
from webloom.sources import tables
from webloom.streaming import streams

SITE = {
    "/": '<a href="/a">a</a><a href="/b?utm_source=x">b</a><a href="https://o.com/">o</a>', "/a": '<a href="/c">c</a><a href="/">home</a>', "/b": '<meta name=robots content=nofollow><a href="/never">n</a>',
    "/c": '<a href="/d">d</a>', "/d": "deep", "/gone": "x",
}


def answers(spark):
    rows = [(f"https://e.com{p}", f"<body>{h}</body>", 200, None) for p, h in SITE.items()] + [("https://e.com/r", None, 302, "/a"), ("https://e.com/loop", None, 301, "/loop")]
    return spark.createDataFrame(rows, "url string, html string, status int, location string")


def test_crawl(spark):
    state, parsed = crawl.crawl(spark, ["https://e.com/", "https://e.com/loop", "https://e.com/missing"], answers(spark), crawl.CrawlPlan(max_depth=2, same_domain_only=True))
    got = {r["url"]: (r["depth"], r["state"]) for r in state.collect()}
    assert got["https://e.com/"] == (0, "processed") and got["https://e.com/a"] == (1, "processed") and got["https://e.com/c"] == (2, "processed")
    assert got["https://e.com/loop"] == (0, "failed") and got["https://e.com/missing"] == (0, "failed")
    assert "https://e.com/never" not in got and "https://e.com/d" not in got and "https://o.com/" not in got
    assert parsed.count() == 4


def test_depths(spark):
    edges = spark.createDataFrame([(n, 10 * n + k) for n in (0, *range(1, 12)) for k in range(1, 11)], "src int, dst int")
    got = crawl.graph_depths(edges, spark.createDataFrame([(0,)], "url int"), 2).groupBy("depth").count().orderBy("depth").collect()
    assert [tuple(r) for r in got] == [(0, 1), (1, 10), (2, 100)]


def test_storage(spark, tmp_path):
    rows = [("https://e.com/1", "=T", 'a\n"b",c', ["x"], "{}", 200), ("https://e.com/2", "", "", [], "{}", 404)]
    df = spark.createDataFrame(rows, "url string, title string, text string, links array<string>, metadata string, status_code int").withColumn("crawled_at", F.lit("2024-01-01 00:00:00").cast("timestamp")).withColumn("content_type", F.lit("text/html")).select(*tables.RECORD_FIELDS)
    want = sorted(map(tuple, df.collect()), key=str)
    tables.write_json_records(df, str(tmp_path / "j.jsonl"))
    assert sorted(map(tuple, tables.read_json_records(spark, str(tmp_path / "j.jsonl")).collect()), key=str) == want
    tables.write_csv_records(df, str(tmp_path / "c"))
    assert sorted(map(tuple, tables.read_csv_records(spark, str(tmp_path / "c")).collect()), key=str) == want
    assert tables.export_json_array(df, str(tmp_path / "a.json")) == 2
    assert len(json.loads((tmp_path / "a.json").read_text())) == 2
    for _ in range(2):
        tables.write_sqlite(df, str(tmp_path / "p.db"))
    assert sorted(map(tuple, tables.read_sqlite(spark, str(tmp_path / "p.db"), 2).collect()), key=str) == want
    tables.upsert_parquet(spark, df, str(tmp_path / "u"))
    tables.upsert_parquet(spark, df.withColumn("title", F.lit("new")).withColumn("crawled_at", F.lit("2024-01-02 00:00:00").cast("timestamp")), str(tmp_path / "u"))
    assert {r["title"] for r in tables.read_upserted(spark, str(tmp_path / "u")).collect()} == {"new"}

    def fails(_):
        raise OSError("full")

    acks = tables.write_all(df, {"ok": lambda d: None, "bad": fails})
    assert {r["dropped"] for r in tables.settled(acks, 2).collect()} == {True}
    with pytest.raises(ValueError):
        tables.writer_for("x.unknown")


def test_url_list_and_cookies(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("﻿# c\nhttps://e.com/\r\n\nhttps://e.com/\nbad url\nftp://x\n".encode())
    good, bad = tables.read_urls(spark, str(tmp_path / "u.txt"))
    assert [tuple(r) for r in good.collect()] == [("https://e.com/", 2)] and sorted(r["line"] for r in bad.collect()) == [5, 6]
    (tmp_path / "c.txt").write_text("# Netscape HTTP Cookie File\n.e.com\tTRUE\t/\tFALSE\t0\ta\t1\n#HttpOnly_e.com\tFALSE\t/\tTRUE\t5\tb\t2\ne.com\tFALSE\t/\tTRUE\t9999999999\tc\t3\n127.0.0.1\tFALSE\t/\tFALSE\t0\td\t4\n")
    assert sorted(r["name"] for r in tables.read_cookies(spark, str(tmp_path / "c.txt"), 100.0).collect()) == ["a", "c"]


def test_config(tmp_path):
    assert config.build({}).crawler.max_pages == 100
    with pytest.raises(config.ConfigError) as e:
        config.build({"crawler": {"max_page": 1, "max_depth": -1}, "filters": {"include": ["("]}, "retry": {"base_delay": "x"}})
    assert len(e.value.problems) == 4 and "did you mean max_pages" in str(e.value)
    (tmp_path / "c.json").write_text('{"urls": ["https://e.com/"], "crawler": {"max_pages": 3}}')
    loaded = config.load(tmp_path / "c.json", {"crawler": {"max_depth": 0}})
    assert (loaded.crawler.max_pages, loaded.crawler.max_depth, loaded.plan().max_depth) == (3, 0, 0)
    (tmp_path / "d.json").write_text('{"urls": [], "urls": []}')
    with pytest.raises(config.ConfigError):
        config.load(tmp_path / "d.json")
    assert config.differences({"a": {"b": 1}, "c": 2}, {"a": {"b": 3}, "c": 2}) == ["a.b"]


def test_report(spark, tmp_path):
    pages = spark.createDataFrame([("a<b", 200, 1.0, None, False), ("c", 404, 3.0, "PermanentHTTPError", False), (None, None, None, None, True)], "host string, status int, elapsed double, error string, skipped boolean")
    found = report.crawl_stats(pages, 4.0)
    assert (found["successful"], found["failed"], found["skipped"], found["avg_response_time"]) == (1, 1, 1, 2.0)
    page = report.render_html(found, "T<")
    assert "T&lt;" in page and "404 Not Found" in page and "a&lt;b" in page
    assert len(report.export(found, str(tmp_path / "s.json"), str(tmp_path / "r.html"))) == 2


def test_streams(spark, tmp_path):
    N = "NetworkError"
    for i, part in enumerate(([(0.0, N), (1.0, N)], [(2.0, N), (3.0, N), (4.0, None)])):
        rows = [("h", t, int(10 * i + k), e, None) for k, (t, e) in enumerate(part)]
        spark.createDataFrame(rows, "host string, t double, call_id long, error_class string, status int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    source = spark.readStream.schema("host string, t double, call_id long, error_class string, status int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    from webloom.operators.politeness import Breaker

    q = streams.breaker_stream(source, Breaker(0.5, 4, 60.0, 30.0)).writeStream.format("memory").queryName("breaker").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("breaker").orderBy("t").toPandas()
    assert got.admitted.tolist() == [True] * 4 + [False] and got.state.tolist()[3] == "open"
    spark.createDataFrame([(1, "https://e.com/?utm_a=1", "<p>x"), (2, "https://e.com/", "<p>y")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    q = streams.first_seen(streams.parse_stream(streams.page_stream(spark, str(tmp_path / "pages")))).select("form", "page.text").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == 1


def test_queries_have_unique_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_long_chain(spark):
    """Eleven levels of one page: positions don't grow with depth."""
    from webloom.plans import crawl

    rows = [(f"https://chain.example/{i}", f'<a href="/{i + 1}">next</a>') for i in range(14)]
    plan = crawl.CrawlPlan(max_depth=10, max_pages=100, respect_robots=False)
    state, _ = crawl.crawl(spark, ["https://chain.example/0"], spark.createDataFrame(rows, "url string, html string"), plan)
    got = {r["url"]: (r["depth"], r["state"]) for r in state.collect()}
    assert got == {f"https://chain.example/{i}": (i, "processed") for i in range(11)}
    assert state.agg({"seq": "max"}).first()[0] < 1000


def test_redirects_to_known_pages_and_sitemaps(spark):
    from webloom.plans import crawl

    html = [("https://r.example/", '<a href="/old">o</a><a href="/new">n</a><a href="/old2">o</a>', 200, None), ("https://r.example/new", "<title>n</title>", 200, None),
            ("https://r.example/old", None, 301, "/new"), ("https://r.example/old2", None, 301, "/far"), ("https://r.example/far", "<title>f</title>", 200, None), ("https://r.example/extra", "<title>e</title>", 200, None)]
    answers = spark.createDataFrame(html, "url string, html string, status int, location string")
    body = b"<urlset><url><loc>https://r.example/extra</loc></url><url><loc>https://r.example/far?utm_source=x</loc></url></urlset>"
    listed = spark.createDataFrame([("https://r.example/map.xml", body)], "url string, body binary")
    plan = crawl.CrawlPlan(max_depth=1, respect_robots=False)
    state, parsed = crawl.crawl(spark, ["https://r.example/"], answers, plan, listed=listed, roots=listed.select("url"))
    got = {r["url"].rpartition("/")[2]: (r["state"], r["depth"]) for r in state.collect()}
    assert got[""] == ("processed", 0) and got["extra"] == ("processed", 0) and got["far"] == ("processed", 0)
    assert got["old"][0] == "skipped" and got["old2"][0] == "skipped" and got["new"] == ("processed", 1)
    assert parsed.select("url").distinct().count() == 4
    alone, _ = crawl.crawl(spark, ["https://r.example/old2"], answers, plan)
    assert {r["url"].rpartition("/")[2]: r["state"] for r in alone.collect()} == {"old2": "processed", "far": "seen"}


def test_answers_are_chosen_alike(spark):
    from webloom.plans import crawl

    df = spark.createDataFrame([("https://e.com/", i, f"<p>{i}") for i in (404, 200, 500)] + [("https://e.com/", None, "x")], "url string, status int, html string")
    assert {crawl.fetched(df.repartition(n)).first()["status"] for n in (1, 2, 3, 4)} == {200}


def test_levels_are_not_broadcast(spark):
    """Outcomes of a level, of which a few columns of a wide table are estimated too small, are merged with the frontier."""
    from webloom.operators import frontier
    from webloom.operators.order import checkpointed

    pages = spark.range(20_000).select(F.concat(F.lit("https://wide.example/" + "x" * 80), "id").alias("url"), F.lit("wide.example").alias("host"), F.lit(0).alias("depth"), F.col("id").alias("seq"))
    state = checkpointed(frontier.new_rows(pages))
    level = checkpointed(pages.select("url", F.lit("processed").alias("outcome"), *[F.lit("y").alias(f"c{i}") for i in range(60)]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "128k")
        done = frontier.finish(state, level.select("url", "outcome"), 1.0)
        new, _ = frontier.add(state, level.select("url", F.lit(0).alias("position")), 1)
        _, may = frontier.mark_seen(state, level.select("url", F.lit("https://s.example/").alias("source")))
        for df, n in ((done, 20_000), (new, 0), (may, 20_000)):
            assert len(df.collect()) == n
            sent = [line for line in df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].split("\n") if "BroadcastHashJoin" in line]
            assert not [line for line in sent if "url" in line], sent
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_answers_are_shaped_once(spark):
    """However many levels a crawl has, its answers are computed once."""
    met = spark.sparkContext.accumulator(0)

    def counted(rows):
        for r in rows:
            met.add(1)
            yield r

    html = spark.createDataFrame([(f"https://once.example/{i}", f'<a href="/{i + 1}">next</a>') for i in range(4)], "url string, html string")
    answers = spark.createDataFrame(html.rdd.mapPartitions(counted), html.schema)
    state, _ = crawl.crawl(spark, ["https://once.example/0"], answers, crawl.CrawlPlan(max_depth=3))
    assert state.where("state = 'processed'").count() == 4 and met.value == 4


@pytest.fixture
def odd_pages(spark, tmp_path):
    """Pages as the driver's larger tables have some: titles and headings cut within a reference, a URL of two pages."""
    text = "A&amp;B &copy; &quot;c&quot; d&amp"
    rows = [(i, f"https://e.example/{i // 2}", f'<!DOCTYPE html><html lang="en"><head><title>{text}</title></head><body><h1>{text}</h1><p>{i}</body></html>') for i in range(4)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


def against_sql(spark, folder, name):
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    got = sorted(map(tuple, entry.queries()[name](spark, folder).collect()))
    assert len(got) == 4 and got == sorted(db.sql(entry.oracle_sql()[name]).fetchall())


def test_headings_extract_against_sql(spark, odd_pages):
    against_sql(spark, odd_pages, "headings_extract")


def test_title_extract_against_sql(spark, odd_pages):
    against_sql(spark, odd_pages, "title_extract")


def test_records_upsert_against_sql(spark, odd_pages):
    against_sql(spark, odd_pages, "records_upsert")
