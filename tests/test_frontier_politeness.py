import random

import pandas as pd
from pyspark.sql import functions as F

from webloom.functions import text
from webloom.operators import errors, frontier, politeness, stats


def test_bounded_add_is_the_loop(spark):
    rnd = random.Random(3)
    rows = [(f"https://h{rnd.randint(0, 4)}.com/{i}", i) for i in range(200)]
    df = spark.createDataFrame([(u, u.split("/")[2], p) for u, p in rows], "url string, host string, position long")
    got = {r["url"]: (r["chosen"], r["by_host"]) for r in frontier.admission(df, 60, 15).collect()}
    accepted, per = 0, {}
    for u, _ in rows:
        h = u.split("/")[2]
        by_host = per.get(h, 0) >= 15
        ok = not by_host and accepted < 60
        assert got[u] == (ok, by_host), u
        if ok:
            accepted, per[h] = accepted + 1, per.get(h, 0) + 1


def test_life_of_pages(spark):
    links = spark.createDataFrame([("https://a.com/?utm_x=1", 1), ("https://a.com/", 0), ("https://b.com/1", 2), ("bad", 3), ("https://b.com/2", 4)], "url string, position long")
    rows, judged = frontier.add(frontier.empty(spark), links, 0)
    assert sorted(r["url"] for r in rows.collect()) == ["https://a.com/", "https://b.com/1", "https://b.com/2"]
    taken = frontier.take(rows, 0.0, 10)
    assert sorted(r["url"] for r in taken.collect()) == ["https://a.com/", "https://b.com/1"]
    leased = frontier.lease(rows, taken, "w", 5.0)
    assert {r["state"]: r["pages"] for r in frontier.state_counts(leased).collect()} == {"leased": 2, "queued": 1}
    back = frontier.reclaim(leased, 6.0)
    assert back.where("state = 'queued' and attempts = 1").count() == 2
    done = frontier.finish(leased, spark.createDataFrame([("https://a.com/", "processed", None), ("https://b.com/1", "failed", "HTTP 404")], "url string, outcome string, reason string"), 7.0)
    assert {r["url"]: r["state"] for r in done.collect()} == {"https://a.com/": "processed", "https://b.com/1": "failed", "https://b.com/2": "queued"}
    assert [r["url"] for r in frontier.unsaved(done).collect()] == ["https://b.com/1"]
    again = frontier.put_back(leased, spark.createDataFrame([("https://a.com/",)], "url string"), 7.0, 3.0, waited=True)
    row = again.where("url = 'https://a.com/'").first()
    assert (row["state"], row["not_before"], row["waits"]) == ("queued", 10.0, 1) and row["seq"] > 4
    new, verdicts = frontier.mark_seen(done, spark.createDataFrame([("https://c.com/", "https://a.com/"), ("https://b.com/2", "https://a.com/")], "url string, source string"))
    assert {r["url"]: r["may_follow"] for r in verdicts.collect()} == {"https://c.com/": True, "https://b.com/2": False}
    assert new.first()["state"] == "seen"
    gone = frontier.give_up_hosts(done, spark.createDataFrame([("b.com", "unreachable", "circuit", None)], "host string, outcome string, reason string, error string"), 9.0)
    assert gone.where("state = 'unreachable'").count() == 1
    kept = frontier.upsert_latest(spark.createDataFrame([("a", 1, "old")], "url string, seq int, v string"), spark.createDataFrame([("a", 2, "new"), ("b", 1, "x")], "url string, seq int, v string"))
    assert sorted(map(tuple, kept.collect())) == [("a", 2, "new"), ("b", 1, "x")]


def test_admit(spark):
    df = spark.createDataFrame([(f"u{i}", "ab"[i % 2], 0, i) for i in range(8)], "url string, host string, depth int, seq long")
    got = {r["url"]: r["admission"] for r in frontier.admit(df, 5, 2).collect()}
    assert [got[f"u{i}"] for i in range(8)] == ["admitted"] * 4 + ["over_host_limit"] * 4


def test_schedule_is_the_loop(spark):
    rnd = random.Random(1)
    rows = [(h, rnd.uniform(0, 20), i) for i in range(60) for h in [rnd.choice("ab")]]
    got = {r["i"]: r["start"] for r in politeness.scheduled_starts(spark.createDataFrame(rows, "host string, ts double, i int"), F.lit(1.5)).collect()}
    last: dict[str, float] = {}
    for h, t, i in sorted(rows, key=lambda r: r[1]):
        start = max(t, last.get(h, -9) + 1.5)
        last[h] = start
        assert abs(got[i] - start) < 1e-9


def test_breaker(spark):
    N = "NetworkError"
    rows = [("h", float(t), i, e, None) for i, (t, e) in enumerate([(0, N), (1, None), (2, N), (3, N), (4, None), (20, None), (33, N), (40, None), (64, None), (65, None)])]
    got = politeness.breaker_trace(spark.createDataFrame(rows, "host string, t double, call_id long, error_class string, status int"), politeness.Breaker(0.5, 4, 60.0, 30.0)).orderBy("t").toPandas()
    assert got.admitted.tolist() == [True] * 4 + [False, False, True, False, True, True]
    assert got.state.tolist()[3] == "open" and got.state.tolist()[6] == "open" and got.state.tolist()[-1] == "closed" and got.times_opened.tolist()[-1] == 2


def test_retries_and_errors(spark):
    p = politeness.RetryPolicy()
    df = spark.createDataFrame([("TransientHTTPError", 429, 2, 0, None), ("TransientHTTPError", 500, 1, 1, None), ("PermanentHTTPError", 404, 0, 0, None), ("NetworkError", None, 3, 0, None), ("TransientHTTPError", 503, 0, 0, 60.0), ("ParseError", None, 0, 0, None)], "e string, s int, r int, rr int, ra double")
    why = [r[0] for r in df.select(p.refusal(*map(F.col, ("e", "s", "r", "rr", "ra")))).collect()]
    assert why == [None, "no retries left for HTTP 500", "permanent error", "no retries left", "the server wants a wait of 60 s, over the limit of 30 s", "not a retried error type"]
    assert df.select(p.delay(F.col("s"), F.col("e"), F.col("r"), F.col("ra"), F.lit(1.0))).first()[0] == 16.0
    flags = [r[0] for r in df.select(errors.is_failure(F.col("e"), F.col("s"))).collect()]
    assert flags == [None, True, False, True, True, None]
    after = spark.createDataFrame([("120",), ("Thu, 01 Jan 1970 00:01:40 GMT",), ("soon",), (None,)], "v string").select(politeness.retry_after(F.col("v"), F.lit(40.0))).collect()
    assert [r[0] for r in after] == [120.0, 60.0, None, None]
    attempts = spark.createDataFrame([("a", 1, "NetworkError", None), ("a", 2, None, 2.0), ("b", 1, "PermanentHTTPError", None)], "url string, attempt int, error_class string, waited double")
    assert tuple(stats.retries(attempts).first()) == (1, 1, 2.0)
    assert {r["kind"]: r["errors"] for r in stats.errors_by_kind(attempts).collect()} == {"TransientError": 0, "PermanentError": 1, "NetworkError": 1, "ParseError": 0, "other": 0}
    slow = politeness.slowdowns(spark.createDataFrame([("h", 0.0, 1.0), ("h", 0.5, 2.0), ("h", 3.0, 61.0)], "host string, sent_at double, ts double"), 0.5).orderBy("ts").toPandas()
    assert slow.grew.tolist() == [True, False, True] and abs(slow.interval.tolist()[2] - 1.0) < 1e-9


def test_progress(spark):
    s = spark.createDataFrame([(0.0, 0), (5.0, 10), (12.0, 30), (16.0, 50)], "elapsed double, finished long")
    got = stats.progress(s, 100).orderBy("elapsed").toPandas()
    assert got.speed.tolist() == [0.0, 2.0, 2.5, 40 / 11] and got.done.tolist()[-1] == 50


def test_text(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()[0]

    assert [one(text.duration(F.lit(s))) for s in (0.5, 45.2, 125.0, 3725.0)] == ["0s", "45s", "2m 05s", "1h 02m"]
    assert one(text.progress_bar(F.lit(20.9))) == "[####----------------]  20%"
    assert one(text.cleaned(F.lit(" a \n b "))) == "a b"
    assert one(text.unescaped_formula(text.escaped_formula(F.lit("=1+1")))) == "=1+1"
    assert one(text.status_name(F.lit(404))) == "404 Not Found" and one(text.status_name(F.lit(799))) == "799"
    assert one(text.share(F.lit(1), F.lit(0))) == "–"
    assert isinstance(pd.Timestamp(0), pd.Timestamp)


def test_folds_go_over_batches(spark):
    """Keys, also null ones, that reach over several batches, with one state each; counts against a plain loop."""
    rows = [(h, float(t), (t * 7 + i) % 5 == 0) for i, h in enumerate(("a", "b", None)) for t in range(300)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = politeness.debounced_failures(spark.createDataFrame(rows, "host string, t double, ok boolean"), 2.0).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {}
    for host in ("a", "b", None):
        counted, last = 0, None
        for h, t, ok in rows:
            if h != host:
                continue
            if ok:
                counted, last = 0, None
            elif last is None or t - last >= 2.0:
                counted, last = counted + 1, t
            want[host, t] = counted
    assert {(r["host"], r["t"]): r["counted"] for r in got} == want
    assert politeness.debounced_failures(spark.createDataFrame([], "host string, t double, ok boolean"), 2.0).count() == 0


def test_busiest_span(spark):
    times = [0, 1, 3_599_999_999, 3_600_000_000, 3_600_000_001, 3_605_000_000, 7_200_000_000, -1]
    row = politeness.busiest_span(spark.createDataFrame([(t,) for t in times], "t long"), 5.0).first()
    counts = [sum(t - 5_000_000 < u <= t for u in times) for t in times]
    assert (row["most"], row["total"]) == (max(counts), sum(counts))


def test_given_up_hosts_forget_what_their_redirects_saw(spark):
    rows = [("https://a.example/", "a.example", 0, 1), ("https://c.example/", "c.example", 0, 2)]
    seen = [("https://b.example/x", "b.example", 0, 3), ("https://a.example/y", "a.example", 0, 4)]
    pages = "url string, host string, depth int, seq long"
    f = frontier.new_rows(spark.createDataFrame(rows, pages)).unionByName(frontier.new_rows(spark.createDataFrame(seen, pages), "seen").withColumn("seen_from", F.when(F.col("seq") == 3, "https://a.example/").otherwise("https://c.example/")))
    gone = spark.createDataFrame([("a.example", "unreachable", "r", "NetworkError")], "host string, outcome string, reason string, error string")
    assert {r["url"]: r["state"] for r in frontier.give_up_hosts(f, gone, 1.0).collect()} == {"https://a.example/": "unreachable", "https://c.example/": "queued", "https://a.example/y": "seen"}
