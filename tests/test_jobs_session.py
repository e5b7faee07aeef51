import json
import logging

import pytest

from webloom import cli
from webloom.functions import session
from webloom.operators import frontier, jobs
from webloom.sources import tables, web


def test_problems():
    assert session.header_name_problem("X-A") is None and session.header_name_problem("a b") and session.header_name_problem("Host")
    assert session.header_value_problem("a\nb") and session.header_value_problem("") and session.header_value_problem("ok") is None
    assert session.cookie_name_problem("path") and session.cookie_name_problem("sid") is None
    assert session.cookie_value_problem('a"b') and session.cookie_value_problem("abc") is None
    assert session.cookie_domain_problem("127.0.0.1") and session.cookie_domain_problem("http://e.com") and session.cookie_domain_problem(".e.com") is None


def test_cookies(spark, tmp_path):
    rows = [("e.com", False, "/", False, None, "a", "1", False), (".e.com", True, "/", True, 9999999999.0, "b", "2", True)]
    before = spark.createDataFrame(rows, session.COOKIES)
    now = spark.createDataFrame([rows[0][:6] + ("9", False), ("n.com", False, "/", False, None, "c", "3", False)], session.COOKIES)
    changed, removed = session.cookie_changes(before, now)
    assert sorted(r["name"] for r in changed.collect()) == ["a", "c"] and [r["name"] for r in removed.collect()] == ["b"]
    session.write_cookies(before, tmp_path / "c.txt")
    assert (tmp_path / "c.txt").stat().st_mode & 0o777 == 0o600
    assert sorted(map(tuple, tables.read_cookies(spark, str(tmp_path / "c.txt"), 0.0).collect())) == sorted(rows)


def test_fetch_results(spark):
    rows = [("https://e.com/1", 200, "text/html; charset=latin-1", bytearray("é".encode("latin-1"))), ("https://e.com/2", 503, None, None), ("https://e.com/3", 200, "text/html", bytearray(b"x" * 50)), ("https://e.com/4", 200, "image/png", bytearray(b"p"))]
    df = spark.createDataFrame(rows, "url string, status int, content_type string, body binary")
    got = {r["url"][-1]: r for r in web.fetch_results(df, max_page=20).collect()}
    assert got["1"]["content"] == "é" and got["2"]["error_class"] == "TransientHTTPError" and got["3"]["error_class"] == "PageTooLargeError" and got["4"]["content"] is None and got["4"]["error_class"] is None
    many = web.fetch_many(spark.createDataFrame([("https://e.com/9", 0), ("https://e.com/1", 1)], "url string, pos int"), df).collect()
    assert [r["error_class"] for r in many] == ["NetworkError", None]
    assert web.bodies(web.fetch_results(df)).count() == 2


def test_jobs(spark, tmp_path):
    store = jobs.Jobs(spark, str(tmp_path))
    start = spark.createDataFrame([("https://a.com/", 0), ("https://b.com/", 1)], "url string, position long")
    f = store.create("j", {"a": 1}, start, now=1.0)
    assert f.count() == 2 and store.find("j")["state"] == "running"
    with pytest.raises(jobs.JobError):
        store.create("j", {"a": 1}, start)
    with pytest.raises(jobs.JobError, match="a"):
        store.create("j", {"a": 2}, start, jobs.RESUME)
    more = spark.createDataFrame([("https://a.com/", 0), ("https://c.com/", 1)], "url string, position long")
    assert store.create("j", {"a": 1}, more, jobs.RESUME).count() == 3
    assert store.create("j", {"a": 3}, more, jobs.RESTART).count() == 2
    f = store.frontier("j")
    hosts = spark.createDataFrame([("a.com", 50.0, False)], "host string, next_allowed_at double, given_up boolean")
    w = jobs.wait_state(f, hosts, "w", 10.0).first()
    assert w["ready"] and w["queued"] and not w["others_busy"] and w["due"] == 40.0
    done = frontier.finish(f, spark.createDataFrame([("https://a.com/", "processed", 200), ("https://c.com/", "failed", 404)], "url string, outcome string, status int"), 5.0)
    assert jobs.is_finished(done) and not jobs.is_finished(f)
    found = jobs.job_stats(done)
    assert (found["successful"], found["failed"], found["status_codes"]) == (1, 1, {"200": 1, "404": 1})
    store.save("j", done, {"a": 3}, 9.0)
    assert store.find("j")["state"] == "finished"
    with pytest.raises(jobs.JobError):
        store.find("none")
    free, held = jobs.widen_scope(spark.createDataFrame([("https://x.a.com/",), ("https://z.com/",)], "url string"), spark.createDataFrame([("a.com",)], "host string"))
    assert free.first()["url"] == "https://x.a.com/" and held.first()["url"] == "https://z.com/"


def test_json_lines():
    record = logging.LogRecord("n", logging.INFO, "f", 1, "é %d", (1,), None)
    assert json.loads(jobs.JsonLines().format(record))["message"] == "é 1"


def test_job_commands(spark, tmp_path, capsys):
    root = str(tmp_path / "jobs")
    assert cli.main(["job", "status", "j", "--root", root]) == 1
    assert cli.main(["job", "create", "j", "https://a.example/", "https://b.example/", "--root", root]) == 0
    assert cli.main(["job", "create", "j", "https://a.example/", "--root", root]) == 1
    assert cli.main(["job", "create", "k", "--root", root]) == 2
    capsys.readouterr()
    assert cli.main(["job", "status", "j", "--root", root]) == 0
    line = capsys.readouterr().out
    assert "0/100 pages, 0 failed" in line and "queued 2" in line and "ETA --" in line and "lost" not in line
    store = jobs.Jobs(spark, root)
    done = frontier.finish(store.frontier("j"), spark.createDataFrame([("https://a.example/", "processed"), ("https://b.example/", "failed")], "url string, outcome string"), 5.0)
    store.save("j", done, json.loads(store.find("j")["settings"]), 9.0)
    assert cli.main(["job", "status", "j", "--root", root, "--watch", "1"]) == 0
    assert "2/100 pages, 1 failed" in capsys.readouterr().out
    assert cli.main(["job", "report", "j", "--root", root, "--unsaved", str(tmp_path / "u.csv")]) == 0
    assert json.loads(capsys.readouterr().out)["failed"] == 1 and "https://b.example/" in (tmp_path / "u.csv").read_text()
