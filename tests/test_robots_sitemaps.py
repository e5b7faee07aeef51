import gzip
import re

from pyspark.sql import functions as F

from webloom.functions import robotstxt
from webloom.operators import filters, robots, sitemaps

TEXT = """Disallow: /before
User-agent: mybot # me
User-agent: other
Disallow: /a*b
Disallow: /p/*.pdf$
Allow: /a*b/ok
Crawl-delay: 2
Crawl-delay: x
Sitemap: https://u@e.com/s.xml
User-agent: *
Disallow: /
Allow: /robot
User-agent: mybot
Disallow: /tie
Allow: /tie
"""


def test_parse():
    p = robotstxt.parse_robots(TEXT)
    assert [g["agents"] for g in p["groups"]] == [["mybot", "other"], ["*"], ["mybot"]]
    assert p["groups"][0]["delay"] == 2.0 and p["sitemaps"] == ["https://e.com/s.xml"]
    rule = re.compile(robotstxt.rule_pattern("/p/*.pdf$").replace(r"\z", r"\Z"))
    assert rule.match("/p/x.pdf.pdf") and not rule.match("/p/x.pdf?x")
    assert robotstxt.tag_directives(["noindex, NOFOLLOW", "mybot: none", "other: x", "max-snippet: 3"], "MyBot/1") == ["noindex", "nofollow", "none", "max-snippet: 3"]


def test_verdicts(spark):
    downloads = spark.createDataFrame([("https://e.com", 200, TEXT, None), ("https://down.com", 503, None, None), ("https://gone.com", 404, None, None), ("https://dns.com", None, None, "DNSError")], "origin string, status int, text string, error_class string")
    rules = robots.read_rules(downloads)
    found = {r["origin"]: r for r in rules.collect()}
    assert found["https://down.com"]["unreachable"] == "HTTP 503" and found["https://down.com"]["recoverable"] and not found["https://dns.com"]["recoverable"]
    cases = {"https://e.com/axxb/c": False, "https://e.com/axxb/ok": True, "https://e.com/p/a.pdf": False, "https://e.com/p/a.pdf?x": True, "https://e.com/tie": True, "https://e.com/other": True, "https://down.com/": False, "https://down.com/robots.txt": True, "https://gone.com/x": True, "https://none.com/": True}
    pages = spark.createDataFrame([(u,) for u in cases] + [(None,)], "url string")
    got = robots.verdicts(pages, rules, "MyBot/2.0")
    assert {r["url"]: r["allowed"] for r in got.collect()} == cases | {None: False}
    assert got.where("url = 'https://e.com/tie'").first()["crawl_delay"] == 2.0
    assert {r["allowed"] for r in robots.verdicts(spark.createDataFrame([("https://e.com/x",)], "url string"), rules, "stranger").collect()} == {False}
    assert robots.as_rows(rules).where("origin = 'https://e.com'").count() == 7


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = f"<?xml version='1.0'?><sitemapindex {ns}><sitemap><loc>https://e.com/a.xml</loc></sitemap><sitemap><loc>https://o.com/b.xml</loc></sitemap><sitemap><loc>https://e.com/i.xml</loc></sitemap></sitemapindex>"
    a = f"\n<urlset {ns}><url><loc> https://e.com/1 </loc></url><url><loc>nope</loc></url><url><loc>https://e.com/2</loc></url><url><loc>https://e.com/1</loc></url></urlset>"
    packed = gzip.compress(a[:40].encode()) + gzip.compress(a[40:].encode())
    files = spark.createDataFrame([("https://e.com/i.xml", bytearray(index.encode())), ("https://e.com/a.xml", bytearray(packed)), ("https://o.com/b.xml", bytearray(a.encode())), ("https://e.com/bad.xml", bytearray(b"<x"))], "url string, body binary")
    got = sitemaps.expand(files, spark.createDataFrame([("https://e.com/i.xml",)], "url string")).orderBy("pos").collect()
    assert [r["url"] for r in got] == ["https://e.com/1", "https://e.com/2"]
    errors = {r["url"]: r["error"] for r in sitemaps.read_sitemaps(files).collect()}
    assert errors["https://e.com/bad.xml"].startswith("not an XML") and errors["https://e.com/a.xml"] is None
    assert sitemaps.parse_sitemap(packed, 50)["error"] == "larger than 50 bytes"


def test_filters(spark):
    df = spark.createDataFrame([("https://www.e.com/a",), ("https://x.e.com/caf%C3%A9",), ("https://ee.com/a",), ("https://e.com/f.pdf",), (None,)], "url string")

    def kept(**kw):
        return sorted(r["url"] for r in filters.UrlFilter(**kw).apply(df).collect())

    assert kept(allowed_hosts=("www.e.com",)) == ["https://e.com/f.pdf", "https://www.e.com/a", "https://x.e.com/caf%C3%A9"]
    assert kept(allowed_hosts=()) == []
    assert kept(extensions=(".PDF",), include=("/café",)) == ["https://x.e.com/caf%C3%A9"]
    assert kept(exclude=("(?i)/A$",)) == ["https://e.com/f.pdf", "https://x.e.com/caf%C3%A9"]
    assert kept(max_length=18) == ["https://ee.com/a"]
    types = spark.createDataFrame([("Text/HTML; charset=x",), (None,), ("image/png",)], "t string")
    assert [r[0] for r in types.select(filters.is_html_content_type(F.col("t"))).collect()] == [True, True, False]
