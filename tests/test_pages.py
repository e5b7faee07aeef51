from pyspark.sql import functions as F

from webloom.functions import charset, html
from webloom.operators import pages

PAGE = """<!DOCTYPE html><html lang=" fi "><head><title>
 Harbour   log</title><base href="/north/"><meta name="KEYWORDS" content="tide,, ferry ,"><meta name="Robots" content="NoArchive,NOINDEX"><link rel="alternate CANONICAL" href="log?d=1">
<meta property="og:description" content=" Ships and tides "></head><body><header><a href="quay">Quay</a><a href="quay#2">2</a><a href="http://coast.example/" rel="me nofollow">c</a></header>
<main><h1>Harbour <i>log</i></h1><p>First<p>second<script>"</p>"</script><img src="data:," data-src="map.svg" alt=" old   map ">
<table><caption>Tides</caption><tr><th>at<th>m<tr><td>06<td>1.2<table><tr><td>low</table></table>
<ol><li>in<ol><li>deep</ol><li>out</ol></main><noscript><a href="/none">h</a></noscript></body></html>"""


def test_fields():
    p = html.parse_page(PAGE, "https://port.example/p")
    assert p["title"] == "Harbour log" and p["metadata"]["language"] == "fi"
    assert p["metadata"]["keywords"] == ["tide", "ferry"] and p["metadata"]["robots"] == ["noarchive", "noindex"]
    assert p["metadata"]["canonical"] == "https://port.example/north/log?d=1" and p["metadata"]["description"] == "Ships and tides"
    assert p["links"] == ["https://port.example/north/quay", "http://coast.example/"]
    assert p["headings"] == [{"level": 1, "text": "Harbour log"}]
    assert p["images"] == [{"src": "https://port.example/north/map.svg", "alt": "old map"}]
    assert p["tables"] == [{"caption": "Tides", "headers": ["at", "m"], "rows": [["06", "1.2 low"]]}, {"caption": None, "headers": [], "rows": [["low"]]}]
    assert p["lists"] == [{"type": "ol", "items": ["in", "out"]}, {"type": "ol", "items": ["deep"]}]
    assert p["text"].startswith("Harbour log First second") and p["errors"] == []
    assert html.parse_page(PAGE, "https://port.example/p", skip_nofollow=True, same_host_only=True)["links"] == ["https://port.example/north/quay"]


def test_broken_markup():
    p = html.parse_page("<title>Half <i>open</title><h3><a href='x'>In<i>side</h3><table><tr><th>k<tr><td>5<td>6</table><ol><li>a<li>b", "https://e.com/")
    assert p["title"] == "Half <i>open" and p["tables"][0]["rows"] == [["5", "6"]] and p["lists"][0]["items"] == ["a", "b"]
    deep = html.parse_page("<div>" * 20_000 + "x", "https://e.com/")
    assert deep["text"] == "x"
    assert html.parse_page("  ", "https://e.com/")["problem"] == "empty document"
    assert html.parse_page("x", "https://e.com/", content_type="image/png")["problem"]
    assert html.parse_page("plain", "https://e.com/")["errors"]


def test_content_root():
    def text(body):
        return html.parse_page(f"<body><p>out</p>{body}", "https://e.com/")["text"]

    assert text("<article>1<article>2</article></article>") == "1 2"
    assert text("<article>1</article><article>2</article>") == "out 1 2"
    assert text("<article>1</article><main>m</main>") == "m"
    assert html.text_of(html.Tree("<div><p>1<b>2</b></p></div><p>3</p>"), "div, p, b") == "12 3"


def test_selector():
    tree = html.Tree("<div id=a class='x y'><p>1</p><div class=x><p data-k=v>2</p></div></div>")
    assert html.text_of(tree, "div.x p") == "1 2" and html.text_of(tree, "p[data-k=v]") == "2" and html.text_of(tree, "#a, p") == "1 2"


def test_parse_and_summary(spark):
    df = pages.parse_pages(spark.createDataFrame([("https://port.example/p", PAGE), ("https://e.com/q", None)], "url string, html string"))
    row = {r["url"]: r for r in pages.summary(df).collect()}["https://port.example/p"]
    assert (row["internal_links"], row["external_links"], row["tables"]) == (1, 1, 2)
    assert pages.links(df).count() == 2
    record = pages.page_records(df.withColumn("status", F.lit(200)).withColumn("content_type", F.lit("text/html")), F.lit(1), F.lit("2024-01-01")).first()
    assert record["title"] == "Harbour log" and record["status_code"] == 200


def test_charsets():
    assert charset.decode_body("text/html; charset=latin-1", "é".encode("latin-1")) == "é"
    assert charset.decode_body(None, b'<meta charset="windows-1251">' + "я".encode("cp1251")).endswith("я")
    assert charset.decode_body("text/html; charset=latin-1", b"\xef\xbb\xbf\xc3\xa9") == "é"
    assert charset.decode_body("x; charset=nope", "é".encode()) == "é"
    assert charset.decode_body(None, b'<meta charset="utf-16">\xc3\xa9').endswith("é")


def test_verdicts(spark):
    df = spark.createDataFrame([(["noindex"], ["nofollow"]), (None, ["none"]), (None, [])], "h array<string>, m array<string>")
    reason, nofollow = pages.robots_verdict(F.col("h"), F.col("m"))
    assert [tuple(r) for r in df.select(reason, nofollow).collect()] == [("noindex in X-Robots-Tag", True), ("noindex in a robots meta tag", True), (None, False)]


def test_only_wanted_fields():
    body = "<html lang='x'><head><title>T</title></head><body><h1>One</h1><template><a href='/no'>n</a></template><ul><li><a href='/y'>y</a></li></ul></body></html>"
    whole = html.parse_page(body, "https://w.example/")
    assert whole["links"] == ["https://w.example/y"] and whole["title"] == "T" and whole["headings"] == [{"level": 1, "text": "One"}]
    few = html.parse_page(body, "https://w.example/", fields=("links",))
    assert few["links"] == whole["links"] and few["title"] is None and few["text"] == "" and few["headings"] == [] and few.keys() == whole.keys()


def test_deep_nesting_takes_linear_time():
    deep = "<div>" * 20_000 + "<a href='/x'>x</a>" * 2_000
    assert html.parse_page(deep, "https://w.example/")["links"] == ["https://w.example/x"]
