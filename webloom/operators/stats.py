"""Reports of a crawl as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.errors import KINDS, OTHER, kind

TOP_DOMAINS = 10


def outcomes(pages: DataFrame, elapsed: float | None = None) -> DataFrame:
    """One row for pages(host, status, elapsed, error, skipped): totals, speed, mean response time."""
    failed = F.col("error").isNotNull()
    skipped = ~failed & F.coalesce("skipped", F.lit(False))
    total = F.count(F.lit(1))
    speed = F.lit(0.0) if not elapsed else total / F.lit(float(elapsed))
    return pages.agg(
        total.alias("total_pages"), F.count_if(~failed & ~skipped).alias("successful"), F.count_if(failed).alias("failed"), F.count_if(skipped).alias("skipped"),
        speed.alias("pages_per_second"), F.coalesce(F.avg("elapsed"), F.lit(0.0)).alias("avg_response_time"),
    )


def largest_first(df: DataFrame, key: str, limit: int | None = None, name: str = "pages") -> DataFrame:
    """Counts by key, null keys left out, largest first, equal ones by key."""
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), key)
    return counted if limit is None else counted.limit(limit)


def by_status(pages: DataFrame, status: str = "status") -> DataFrame:
    return pages.where(F.col(status).isNotNull()).groupBy(status).agg(F.count(F.lit(1)).alias("pages")).orderBy(status)


def breakdown(pages: DataFrame) -> DataFrame:
    """(what, key, pages): statuses, errors and hosts from one pass over pages, by grouping sets."""
    sets = pages.groupingSets([["status"], ["error"], ["host"]], "status", "error", "host").agg(F.count(F.lit(1)).alias("pages"), F.grouping_id().alias("g"))
    what = F.when(F.col("g") == 3, "status").when(F.col("g") == 5, "error").otherwise("host")
    key = F.when(F.col("g") == 3, F.col("status").cast("string")).when(F.col("g") == 5, F.col("error")).otherwise(F.col("host"))
    return sets.select(what.alias("what"), key.alias("key"), "pages").where("key is not null")


def as_map(counts: DataFrame, key: str, value: str) -> DataFrame:
    """One row with the counts as a map in key order."""
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string"), value)))).alias("counts"))


def errors_by_kind(attempts: DataFrame) -> DataFrame:
    """(kind, errors) for every kind, also those without errors."""
    kinds = attempts.sparkSession.createDataFrame([(k,) for k in (*KINDS, OTHER)], "kind string")
    found = attempts.where("error_class is not null").groupBy(kind(F.col("error_class")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("errors"))


def retries(attempts: DataFrame) -> DataFrame:
    """One row from attempts(url, attempt, error_class, waited): retries, URLs recovered, mean wait of a retry."""
    per_url = attempts.groupBy("url").agg(F.max("attempt").alias("last"), F.max_by(F.col("error_class").isNull(), "attempt").alias("ok"))
    done = per_url.agg(F.coalesce(F.sum(F.col("last") - 1), F.lit(0)).alias("retries"), F.count_if((F.col("last") > 1) & F.col("ok")).alias("recovered"))
    waits = attempts.where("attempt > 1").agg(F.coalesce(F.avg("waited"), F.lit(0.0)).alias("avg_retry_seconds"))
    wait = waits.first()[0]  # one number
    return done.withColumn("avg_retry_seconds", F.lit(wait))


def permanent(attempts: DataFrame) -> DataFrame:
    """(url, error_class): where a permanent error was the last word."""
    last = attempts.groupBy("url").agg(F.max_by("error_class", "attempt").alias("error_class"))
    return last.where(kind(F.col("error_class")) == "PermanentError")


def progress(samples: DataFrame, max_pages: int, window: float = 10.0) -> DataFrame:
    """samples(elapsed, finished, ...) with done, percent, speed and eta: speed is over the last `window` seconds.

    It is measured from the latest sample that is at least `window` old, else from the first one.
    """
    from pyspark.sql import Window

    everything = Window.orderBy("elapsed")
    micros = F.round(F.col("elapsed") * 1_000_000).cast("long")
    old = Window.orderBy("__at").rangeBetween(Window.unboundedPreceding, -int(window * 1_000_000))
    point = F.struct(F.col("elapsed").alias("e"), F.col("finished").alias("f"))
    df = samples.withColumn("__at", micros)
    since = F.coalesce(F.last(point).over(old), F.first(point).over(everything))
    df = df.withColumn("__since", since)
    passed = F.col("elapsed") - F.col("__since.e")
    average = F.when(F.col("elapsed") > 0, F.col("finished") / F.col("elapsed")).otherwise(0.0)
    speed = F.when(passed > 0, (F.col("finished") - F.col("__since.f")) / F.nullif(passed, F.lit(0.0))).otherwise(average)
    done = F.least(F.col("finished"), F.lit(max_pages))
    df = df.withColumn("done", done).withColumn("percent", 100.0 * done / max_pages).withColumn("speed", speed)
    return df.withColumn("eta", F.when(F.col("speed") > 0, (max_pages - F.col("done")) / F.nullif(F.col("speed"), F.lit(0.0)))).drop("__at", "__since")


def job_progress(frontier: DataFrame, now: float, max_pages: int, window: float = 30.0) -> DataFrame:
    """One row of a job: done, recent, failed, in progress, queued (no more than can still be crawled), percent, speed, eta."""
    done = F.col("state").isin("processed", "saving", "failed", "skipped")
    row = frontier.agg(
        F.count_if(done).alias("done"), F.count_if(done & (F.col("finished_at") > now - window)).alias("recent"), F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state") == "leased").alias("in_progress"), F.count_if(F.col("state") == "queued").alias("waiting"),
    )
    left = F.greatest(F.lit(max_pages) - F.col("done"), F.lit(0))
    row = row.withColumn("queued", F.least(F.col("waiting"), F.greatest(left - F.col("in_progress"), F.lit(0)))).withColumn("speed", F.col("recent") / F.lit(window))
    return row.withColumn("percent", 100.0 * F.least(F.col("done"), F.lit(max_pages)) / max_pages).withColumn("eta", F.when(F.col("speed") > 0, left / F.nullif(F.col("speed"), F.lit(0.0)))).drop("waiting")


def workers(workers_: DataFrame, frontier: DataFrame) -> DataFrame:
    """worker, saved and failed pages: workers without pages too."""
    held = frontier.where(F.col("state").isin("processed", "saving", "failed", "leased")).select("worker", "state")
    return workers_.join(held, "worker", "left").groupBy("worker").agg(
        F.count_if(F.col("state").isin("processed", "saving")).alias("processed"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state") == "leased").alias("in_progress")
    )


def host_failures(events: DataFrame, max_openings: int = 3, max_robots: int = 3) -> DataFrame:
    """Hosts to give up: circuit opened max_openings times, or robots.txt failed more than max_robots times."""
    sums = events.groupBy("host").agg(F.sum("circuit_openings").alias("openings"), F.sum("robots_failures").alias("robots"))
    reason: Column = F.when(F.col("openings") >= max_openings, "circuit").when(F.col("robots") > max_robots, "robots")
    return sums.withColumn("give_up", reason)
