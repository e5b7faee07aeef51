"""Jobs: a crawl whose frontier, hosts and workers are tables under one path, to be resumed or restarted."""

from __future__ import annotations

import json
import logging
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import frontier as fr
from webloom.operators import stats

NEW, RESUME, RESTART = "new", "resume", "restart"
_JOB = "name STRING, state STRING, settings STRING, version INT, created_at DOUBLE, finished_at DOUBLE"


class JobError(ValueError):
    pass


class Jobs:
    """Job tables under root. A frontier is a version beside its predecessor; the job's row names the one that holds."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _rows(self, name: str) -> list:
        try:
            return self.spark.read.schema(_JOB).json(f"{self.root}/{name}/job").orderBy("version").collect()
        except AnalysisException:
            return []

    def find(self, name: str):
        """The job's latest row; JobError if there is none."""
        rows = self._rows(name)
        if not rows:
            raise JobError(f"there is no job {name!r}")
        return rows[-1]

    def _put(self, name: str, state: str, settings: str, version: int, created_at: float, finished_at: float | None) -> None:
        row = self.spark.createDataFrame([(name, state, settings, version, created_at, finished_at)], _JOB)
        row.coalesce(1).write.mode("append").json(f"{self.root}/{name}/job")

    def create(self, name: str, settings: dict, start: DataFrame, mode: str = NEW, now: float | None = None) -> DataFrame:
        """Seed the job with start(url, position) and return its frontier.

        new: the name has to be free. resume: the settings have to be the same; start URLs that were never queued are added.
        restart: anew.
        """
        now = time.time() if now is None else now
        rows = self._rows(name)
        text = json.dumps(settings, sort_keys=True)
        if mode == NEW and rows:
            raise JobError(f"there is a job {name!r} already")
        if mode == RESUME:
            last = self.find(name)
            if last["settings"] != text:
                from webloom.config import differences

                raise JobError("the settings differ in " + ", ".join(differences(json.loads(last["settings"]), settings)))
            old = self.frontier(name)
        else:
            old = fr.empty(self.spark)
        added, _ = fr.add(old, start, 0)
        return self.save(name, old.unionByName(added), settings, now)

    def save(self, name: str, state: DataFrame, settings: dict, now: float) -> DataFrame:
        """Write a new version of the frontier, then the row that names it."""
        rows = self._rows(name)
        version = (rows[-1]["version"] if rows else 0) + 1
        path = f"{self.root}/{name}/frontier-{version}"
        state.write.mode("overwrite").parquet(path)
        kept = self.spark.read.schema(fr.FRONTIER).parquet(path)
        waiting = not kept.where("state in ('queued', 'leased', 'saving')").isEmpty()
        self._put(name, "running" if waiting else "finished", json.dumps(settings, sort_keys=True), version, rows[0]["created_at"] if rows else now, None if waiting else now)
        return kept

    def frontier(self, name: str) -> DataFrame:
        return self.spark.read.schema(fr.FRONTIER).parquet(f"{self.root}/{name}/frontier-{self.find(name)['version']}")


def page_totals(frontier: DataFrame) -> DataFrame:
    """One row: successful (pages pending their save too), failed, skipped, mean response time, queued, in progress."""
    state = F.col("state")
    counted = state.isin("processed", "saving", "failed", "skipped")
    return frontier.agg(
        F.count_if(state.isin("processed", "saving")).alias("successful"), F.count_if(state == "failed").alias("failed"), F.count_if(state == "skipped").alias("skipped"),
        F.coalesce(F.avg(F.when(counted, F.col("elapsed"))), F.lit(0.0)).alias("avg_response_time"), F.count_if(state == "queued").alias("queued"), F.count_if(state == "leased").alias("in_progress"),
    )


def job_stats(frontier: DataFrame, top_domains: int = 10) -> dict:
    """Totals, statuses, errors and largest hosts of a job."""
    counted = frontier.where(F.col("state").isin("processed", "saving", "failed", "skipped"))
    lists = {"status_codes": stats.by_status(counted).limit(1000), "errors": stats.largest_first(counted.where("state = 'failed'"), "error", 1000), "top_domains": stats.largest_first(counted, "host", top_domains)}
    return page_totals(frontier).first().asDict() | {k: {str(r[0]): r[1] for r in df.collect()} for k, df in lists.items()}


def progress_line(job, frontier: DataFrame, now: float, max_pages: int, window: float = 30.0) -> str:
    """A line of how far a job (its row) has come."""
    from webloom.functions.text import job_line

    row = stats.job_progress(frontier, now, max_pages, window).withColumn("workers", F.lit(frontier.where("state = 'leased'").select("worker").distinct().count()))
    given = {"state": F.lit(job["state"]), "total": F.lit(max_pages), "lost": F.lit(0), "elapsed": F.lit((job["finished_at"] or now) - job["created_at"])}
    return row.select(job_line({c: F.col(c) for c in row.columns} | given)).first()[0]


def watch(store: Jobs, name: str, max_pages: int, seconds: float = 2.0, show=print, clock=time.time, sleep=time.sleep) -> None:
    """Show a job's progress until it has finished; JobError if there is none."""
    while True:
        job = store.find(name)
        show(progress_line(job, store.frontier(name), clock(), max_pages))
        if job["state"] == "finished":
            return
        sleep(seconds)


def wait_state(frontier: DataFrame, hosts: DataFrame, worker: str, now: float, max_pages: int | None = None) -> DataFrame:
    """One row for a worker without a page: closed, ready, queued, others_busy, others_counted and due (seconds until something may change)."""
    known = hosts.select("host", "next_allowed_at", "given_up")
    f = frontier.join(known, "host", "left").withColumn("open_at", F.coalesce("next_allowed_at", F.lit(0.0))).withColumn("up", F.coalesce("given_up", F.lit(False)))
    queued = F.col("state") == "queued"
    busy = F.col("state").isin("leased", "saving") & (F.col("worker") != worker)
    later = lambda when, c: F.min(F.when(when & (c > now), c))
    due_at = F.coalesce("not_before", F.lit(0.0))
    closed = F.lit(False) if max_pages is None else F.count_if("counted") >= max_pages
    return f.agg(
        closed.alias("closed"), (F.count_if(queued & (due_at <= now) & ((F.col("open_at") <= now) | F.col("up"))) > 0).alias("ready"), (F.count_if(queued) > 0).alias("queued"),
        (F.count_if(busy) > 0).alias("others_busy"), (F.count_if(busy & F.col("counted")) > 0).alias("others_counted"),
        (F.least(later(queued, F.col("not_before")), later(queued & ~F.col("up"), F.col("open_at")), F.min(F.when(busy, F.col("lease_until")))) - now).alias("due"),
    )


def is_finished(frontier: DataFrame, max_pages: int | None = None) -> bool:
    """No page is under way, and none is left or as many as wanted were requested."""
    row = frontier.agg(F.count_if(F.col("state").isin("leased", "saving")), F.count_if(F.col("state") == "queued"), F.count_if("counted")).first()
    return row[0] == 0 and (row[1] == 0 or (max_pages is not None and row[2] >= max_pages))


def widen_scope(held: DataFrame, scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(released, still held) of held(url) after scope(host) has grown."""
    from webloom.operators.filters import in_scope

    free = in_scope(held, scope)
    return free, held.join(free.select("url"), "url", "left_anti")


class JsonLines(logging.Formatter):
    """Log records as JSON lines: time, level, logger, message and, if there is one, exception."""

    def format(self, record: logging.LogRecord) -> str:
        line = {"time": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(record.created)) + f".{int(record.msecs):03d}Z", "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line, ensure_ascii=False)
