"""python -m webloom.cli: crawl a table of fetched pages by a configuration, parse, report."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from webloom import config as C
from webloom import report


def session(name: str = "webloom") -> SparkSession:
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="webloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl", help="breadth first over fetched pages")
    c.add_argument("urls", nargs="*")
    c.add_argument("--pages", required=True, help="Parquet of url, html and, if known, status, content_type, location")
    c.add_argument("--config")
    c.add_argument("--max-pages", type=int)
    c.add_argument("--max-depth", type=int)
    c.add_argument("--all-domains", action="store_true")
    c.add_argument("--output", action="append", default=[], help="a sink: .jsonl, .json, .csv, .parquet, .db or a URL of a registered scheme")
    c.add_argument("--stats-json")
    c.add_argument("--report")
    d = sub.add_parser("parse", help="parse fetched pages into page structs")
    d.add_argument("--pages", required=True)
    d.add_argument("--output", required=True)
    j = sub.add_parser("job", help="jobs that are kept as tables")
    steps = j.add_subparsers(dest="step", required=True)
    for step, what in (("create", "queue start URLs"), ("status", "a line of progress"), ("report", "totals as JSON, pages that weren't saved as CSV")):
        q = steps.add_parser(step, help=what)
        q.add_argument("name")
        q.add_argument("--root", required=True, help="folder of the jobs' tables, shared by the cluster")
        if step == "create":
            q.add_argument("urls", nargs="*")
            q.add_argument("--config")
            q.add_argument("--resume", action="store_const", dest="mode", const="resume", default="new")
            q.add_argument("--restart", action="store_const", dest="mode", const="restart")
        elif step == "status":
            q.add_argument("--watch", type=float, metavar="SECONDS", help="repeat until the job has finished")
        else:
            q.add_argument("--unsaved", help="CSV file of pages that weren't saved")
    return p


def run_job(spark: SparkSession, args: argparse.Namespace) -> int:
    """job create, status and report; 1: there is no such job, or one already."""
    import dataclasses
    import time

    from webloom.operators import frontier, jobs

    store = jobs.Jobs(spark, args.root)
    try:
        if args.step == "create":
            given = C.load(args.config, {"urls": args.urls} if args.urls else {}) if args.config else C.build({"urls": args.urls}, "arguments")
            if not given.urls:
                raise C.ConfigError(["no URLs to start from"], "arguments")
            start = spark.createDataFrame([(u, i) for i, u in enumerate(given.urls)], "url string, position long")
            settings = json.loads(json.dumps(dataclasses.asdict(given), default=str))
            queued = store.create(args.name, settings, start, args.mode).where("state = 'queued'").count()
            print(f"{args.name}: {queued} pages queued")
            return 0
        job = store.find(args.name)
        limit = json.loads(job["settings"]).get("crawler", {}).get("max_pages", 100)
        if args.step == "status" and args.watch:
            jobs.watch(store, args.name, limit, args.watch)
        elif args.step == "status":
            print(jobs.progress_line(job, store.frontier(args.name), time.time(), limit))
        else:
            state = store.frontier(args.name)
            print(json.dumps(jobs.job_stats(state), ensure_ascii=False, indent=2))
            if args.unsaved:
                report.unsaved_csv(frontier.unsaved(state).toLocalIterator(), args.unsaved)
        return 0
    except jobs.JobError as error:
        print(error, file=sys.stderr)
        return 1


def overrides(args: argparse.Namespace) -> dict:
    out: dict = {"crawler": {}, "filters": {}, "storage": {}, "report": {}}
    if args.urls:
        out["urls"] = args.urls
    for section, key, value in (("crawler", "max_pages", args.max_pages), ("crawler", "max_depth", args.max_depth), ("filters", "same_domain_only", False if args.all_domains else None), ("storage", "outputs", args.output or None), ("report", "stats_json", args.stats_json), ("report", "html", args.report)):
        if value is not None:
            out[section][key] = value
    return out


def run_crawl(spark: SparkSession, given: C.Config, pages_path: str) -> dict:
    from webloom.operators import pages as P
    from webloom.plans.crawl import crawl
    from webloom.sources.tables import writer_for

    state, parsed = crawl(spark, list(given.urls), spark.read.parquet(pages_path), given.plan())
    done = state.where(F.col("state").isin("processed", "failed", "skipped"))
    stats = report.crawl_stats(done.select("host", "status", "elapsed", "error", (F.col("state") == "skipped").alias("skipped")), 0.0, given.report.top_domains)
    if parsed is not None:
        records = P.page_records(parsed, F.lit(None).cast("int"), F.current_timestamp())
        for output in given.storage.outputs:
            writer_for(output)[1](records)
    report.export(stats, given.report.stats_json, given.report.html)
    return stats


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    try:
        if args.command == "parse":
            from webloom.operators import pages as P

            P.parse_pages(session().read.parquet(args.pages)).select("page.*").write.mode("overwrite").parquet(args.output)
            return 0
        if args.command == "job":
            return run_job(session(), args)
        given = C.load(args.config, overrides(args)) if args.config else C.build(overrides(args), "arguments")
        if not given.urls:
            raise C.ConfigError(["no URLs to start from"], "arguments")
    except C.ConfigError as error:
        print(error, file=sys.stderr)
        return 2
    stats = run_crawl(session(), given, args.pages)
    print(report.render_json(stats), end="")
    return 0 if stats["successful"] else 1


if __name__ == "__main__":
    sys.exit(main())
