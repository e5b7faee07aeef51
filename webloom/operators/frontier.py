"""The frontier of a crawl as a table: adding, taking, admitting and finishing pages as set operations.

A frontier has url (its key), host, depth, seq, state, attempts, waits, counted, reason, status, elapsed,
error, not_before, lease_until, worker, finished_at and seen_from. Operators take it and return it; `now` is
an explicit column or number, never the clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.operators.order import merged, numbered, running_count

FRONTIER = (
    "url STRING, host STRING, depth INT, seq BIGINT, state STRING, attempts INT, waits INT, counted BOOLEAN, reason STRING, status INT, elapsed DOUBLE, "
    "error STRING, not_before DOUBLE, lease_until DOUBLE, worker STRING, finished_at DOUBLE, seen_from STRING"
)
STATES = ("seen", "queued", "leased", "saving", "processed", "failed", "skipped", "blocked", "unreachable")
TERMINAL = ("processed", "failed", "skipped", "blocked", "unreachable")
UNSAVED = ("failed", "skipped", "blocked", "unreachable")
FACTOR = 3
MAX_URL_LENGTH = 2048


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], FRONTIER)


def new_rows(pages: DataFrame, state: str = "queued") -> DataFrame:
    """Frontier rows of pages(url, host, depth, seq)."""
    given = {"url": F.col("url"), "host": F.col("host"), "depth": F.col("depth").cast("int"), "seq": F.col("seq").cast("long"), "state": F.lit(state), "attempts": F.lit(0), "waits": F.lit(0), "counted": F.lit(False)}
    fields = [f.strip().split(" ") for f in FRONTIER.split(",")]
    return pages.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])


def candidates(links: DataFrame) -> DataFrame:
    """links(url, position) -> url, host, position: valid, not too long, in queue form, the first of each."""
    keyed = links.select(urls.queue_form(F.col("url")).alias("url"), "position").where(F.col("url").isNotNull() & (F.length("url") <= MAX_URL_LENGTH))
    return keyed.groupBy("url").agg(F.min("position").alias("position")).withColumn("host", urls.host(F.col("url")))


def admission(pages: DataFrame, room: int | None, host_room: int | None, host_before: Column | None = None) -> DataFrame:
    """pages(url, host, position[, host_before]) with fits, chosen and by_host: the bounded insert as one statement.

    A page fits if fewer than host_room of its host come before it; those that fit are chosen in order of position while
    room lasts. A page left out is dropped by its host if pages of its host that were chosen before fill it. The running count over all is made
    of counts per range of positions, so that no task holds all pages.
    """
    before = F.coalesce(host_before if host_before is not None else F.lit(0), F.lit(0))
    by_host = Window.partitionBy("host").orderBy("position")
    fits = F.lit(True) if host_room is None else before + F.row_number().over(by_host) <= host_room
    df = pages.withColumn("host_before", before).withColumn("fits", fits)
    if room is None:
        df = df.withColumn("chosen", F.col("fits"))
    else:
        order = ("position", "url") if "url" in df.columns else ("position",)
        df = running_count(df, F.col("fits"), *order).withColumn("chosen", F.col("fits") & (F.col("running") <= room)).drop("running")
    if host_room is None:
        return df.withColumn("by_host", F.lit(False))
    taken = F.coalesce(F.sum(F.col("chosen").cast("long")).over(by_host.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("by_host", ~F.col("chosen") & (F.col("host_before") + taken >= host_room))


def add(frontier: DataFrame, links: DataFrame, depth: int, max_pages: int | None = None, max_per_host: int | None = None, factor: int = FACTOR) -> tuple[DataFrame, DataFrame]:
    """(the new rows, the judged candidates) of adding links(url, position) to a frontier; unbounded without max_pages."""
    new = candidates(links).join(merged(frontier.select("url")), "url", "left_anti")
    room = host_room = None
    if max_pages is not None:
        counts = frontier.agg(F.count_if(F.col("state").isin("queued", "leased")), F.count_if("counted")).first()
        if counts[1] >= max_pages:
            new = new.where(F.lit(False))
        room = factor * max_pages - counts[0] - counts[1]
        host_room = None if max_per_host is None else factor * max_per_host
        accepted = frontier.where("state != 'seen'").groupBy("host").agg(F.count(F.lit(1)).alias("__accepted"))
        new = new.join(accepted, "host", "left")
    judged = admission(new, room, host_room, F.col("__accepted") if max_pages is not None else None).drop("__accepted")
    last = frontier.agg(F.max("seq")).first()[0] or 0
    rows = judged.where("chosen").withColumn("depth", F.lit(depth)).withColumn("seq", F.col("position") + last + 1)
    return new_rows(rows), judged


def drop_reasons(judged: DataFrame) -> DataFrame:
    """One row: accepted, dropped (no room), dropped_by_host."""
    left = ~F.col("chosen")
    return judged.agg(F.count_if("chosen").alias("accepted"), F.count_if(left & ~F.col("by_host")).alias("dropped"), F.count_if(left & F.col("by_host")).alias("dropped_by_host"))


def take(frontier: DataFrame, now: float, k: int, hosts: DataFrame | None = None) -> DataFrame:
    """The k next pages: of each host that is ready (hosts(host, next_allowed_at)), its first due page by (depth, seq)."""
    due = frontier.where((F.col("state") == "queued") & (F.coalesce("not_before", F.lit(0.0)) <= now))
    if hosts is not None:
        due = due.join(hosts.where(F.col("next_allowed_at") > now).select("host"), "host", "left_anti")
    first = due.groupBy("host").agg(F.min_by(F.struct(*due.columns), F.struct("depth", "seq")).alias("page"))
    return first.select("page.*").orderBy("depth", "seq").limit(k)


def lease(frontier: DataFrame, taken: DataFrame, worker: str, until: float) -> DataFrame:
    chosen = taken.select("url", F.lit(True).alias("__taken"))
    mark = F.coalesce("__taken", F.lit(False))
    joined = frontier.join(chosen, "url", "left")
    return joined.withColumns({"state": F.when(mark, "leased").otherwise(F.col("state")), "worker": F.when(mark, worker).otherwise(F.col("worker")), "lease_until": F.when(mark, F.lit(until)).otherwise(F.col("lease_until"))}).drop("__taken").select(*frontier.columns)


def reclaim(frontier: DataFrame, now: float, max_attempts: int = 3) -> DataFrame:
    """Pages whose lease ran out go back, or fail after max_attempts."""
    lost = F.col("state").isin("leased", "saving") & (F.col("lease_until") < now)
    over = lost & (F.col("attempts") + 1 >= max_attempts)
    return frontier.withColumns(
        {
            "state": F.when(over, "failed").when(lost, "queued").otherwise(F.col("state")),
            "reason": F.when(over, F.format_string("lease expired %d times", F.col("attempts") + 1)).when(lost, F.lit(None)).otherwise(F.col("reason")),
            "error": F.when(over, "LeaseExpired").otherwise(F.col("error")),
            "finished_at": F.when(over, F.lit(now)).otherwise(F.col("finished_at")),
            "attempts": F.when(lost, F.col("attempts") + 1).otherwise(F.col("attempts")),
            "worker": F.when(lost, F.lit(None)).otherwise(F.col("worker")),
            "lease_until": F.when(lost, F.lit(None)).otherwise(F.col("lease_until")),
        }
    )


def admit(pages: DataFrame, max_pages: int, max_per_host: int | None = None, requested: int = 0, host_requested: DataFrame | None = None) -> DataFrame:
    """pages(url, host, depth, seq) with admission: 'admitted', 'over_limit' or 'over_host_limit'; counts go by (depth, seq)."""
    df = pages
    ranked = F.lit(True)
    if max_per_host is not None:
        if host_requested is not None:
            df = df.join(host_requested.select("host", F.col("requested").alias("__requested")), "host", "left")
        else:
            df = df.withColumn("__requested", F.lit(0))
        ranked = F.row_number().over(Window.partitionBy("host").orderBy("depth", "seq")) + F.coalesce("__requested", F.lit(0)) <= max_per_host
    df = df.withColumn("__fits", ranked)
    df = running_count(df, F.col("__fits"), "depth", "seq", "url")
    verdict = F.when(F.col("running") + requested - F.col("__fits").cast("long") >= max_pages, "over_limit").when(~F.col("__fits"), "over_host_limit").otherwise("admitted")
    return df.withColumn("admission", verdict).drop("__fits", "running", "__requested")


def finish(frontier: DataFrame, outcomes: DataFrame, now: float) -> DataFrame:
    """Apply outcomes(url, outcome[, reason, status, elapsed, error, uncount, pending_save]) to leased pages."""
    names = ("reason", "status", "elapsed", "error")
    given = outcomes.select("url", F.col("outcome").alias("__o"), *[(F.col(n) if n in outcomes.columns else F.lit(None)).alias(f"__{n}") for n in (*names, "uncount", "pending_save")])
    done = F.col("__o").isNotNull()
    saving = done & F.coalesce("__pending_save", F.lit(False)) & (F.col("__o") == "processed")
    joined = frontier.join(merged(given), "url", "left")
    changed = {n: F.when(done, F.col(f"__{n}")).otherwise(F.col(n)).cast(frontier.schema[n].dataType) for n in names}
    changed |= {
        "state": F.when(saving, "saving").when(done, F.col("__o")).otherwise(F.col("state")),
        "counted": F.when(done & F.coalesce("__uncount", F.lit(False)), False).otherwise(F.col("counted")),
        "finished_at": F.when(done & ~saving, F.lit(now)).otherwise(F.col("finished_at")),
    }
    return joined.withColumns(changed).select(*frontier.columns)


def put_back(frontier: DataFrame, pages: DataFrame, now: float, delay: float = 0.0, waited: bool = False, uncount: bool = False) -> DataFrame:
    """Requeue pages(url) behind all others, due after a delay."""
    last = frontier.agg(F.max("seq")).first()[0] or 0
    order = numbered(pages.select("url").distinct(), "__seq", "url").withColumn("__seq", F.col("__seq") + last + 1)
    back = F.col("__seq").isNotNull()
    return (
        frontier.join(order, "url", "left")
        .withColumns(
            {
                "state": F.when(back, "queued").otherwise(F.col("state")),
                "seq": F.coalesce("__seq", "seq").cast("long"),
                "not_before": F.when(back, F.lit(now + delay)).otherwise(F.col("not_before")),
                "waits": F.when(back, F.col("waits") + int(waited)).otherwise(F.col("waits")),
                "counted": F.when(back & F.lit(uncount), False).otherwise(F.col("counted")),
                "worker": F.when(back, F.lit(None)).otherwise(F.col("worker")),
                "lease_until": F.when(back, F.lit(None)).otherwise(F.col("lease_until")),
            }
        )
        .select(*frontier.columns)
    )


def mark_seen(frontier: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, verdicts) of redirect targets(url, source): new ones, and those seen from the same source, may be followed."""
    first = targets.groupBy("url").agg(F.min("source").alias("__first"))
    known = frontier.select("url", F.col("seen_from").alias("__from"), F.lit(True).alias("__known"))
    met = targets.join(merged(first), "url").join(merged(known), "url", "left")
    may = F.when(F.col("__known").isNull(), F.col("source") == F.col("__first")).otherwise(F.col("__from") == F.col("source"))
    verdicts = met.select("url", "source", F.coalesce(may, F.lit(False)).alias("may_follow"))
    fresh = first.join(merged(known.select("url")), "url", "left_anti").select("url", urls.host(F.col("url")).alias("host"), F.lit(0).alias("depth"), F.lit(None).alias("seq"), "__first")
    rows = new_rows(fresh.drop("__first"), "seen").drop("seen_from").join(merged(fresh.select("url", F.col("__first").alias("seen_from"))), "url")
    return rows.select(*frontier.columns), verdicts


def put_back_all(frontier: DataFrame, worker: str) -> DataFrame:
    """Requeue, uncounted and behind all others, what a stopping worker has leased; pages that wait for their save keep their lease."""
    mine = (F.col("state") == "leased") & (F.col("worker") == worker)
    last = frontier.agg(F.max("seq")).first()[0] or 0
    order = numbered(frontier.where(mine).select("url", F.col("seq").alias("__old")), "__seq", "__old", "url").drop("__old")
    back = F.col("__seq").isNotNull()
    changed = {
        "state": F.when(back, "queued").otherwise(F.col("state")), "seq": F.coalesce(F.col("__seq") + last + 1, "seq").cast("long"), "counted": ~back & F.col("counted"),
        "worker": F.when(~back, F.col("worker")), "lease_until": F.when(~back, F.col("lease_until")),
    }
    return frontier.join(order, "url", "left").withColumns(changed).select(*frontier.columns)


def settle(frontier: DataFrame, settled: DataFrame, now: float) -> DataFrame:
    """Pages that wait for their save after settled(url, dropped): processed, or failed if a sink has dropped their record."""
    joined = frontier.join(settled.select("url", F.col("dropped").alias("__dropped")), "url", "left")
    done = (F.col("state") == "saving") & F.col("__dropped").isNotNull()
    lost = done & F.col("__dropped")
    changed = {
        "state": F.when(lost, "failed").when(done, "processed").otherwise(F.col("state")), "reason": F.when(lost, "a sink dropped the record").otherwise(F.col("reason")),
        "error": F.when(lost, "RecordDropped").otherwise(F.col("error")), "finished_at": F.when(done, F.lit(now)).otherwise(F.col("finished_at")),
    }
    return joined.withColumns(changed).select(*frontier.columns)


def forget(frontier: DataFrame, targets: DataFrame) -> DataFrame:
    """Without what was only seen by redirects of targets(url, source): it may be queued again."""
    seen = frontier.where("state = 'seen'").join(targets.select("url", F.col("source").alias("seen_from")).distinct(), ["url", "seen_from"], "left_anti")
    return frontier.where("state != 'seen'").unionByName(seen.select(*frontier.columns))


def first_given_up(known: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(host, outcome, reason, error): known hosts keep theirs, others get the earliest of verdicts(host, outcome, reason, error, at)."""
    kept = ["host", "outcome", "reason", "error"]
    first = verdicts.join(known.select("host"), "host", "left_anti").groupBy("host").agg(F.min_by(F.struct(*kept[1:]), F.struct("at", *kept[1:])).alias("v"))
    return known.select(*kept).unionByName(first.select("host", "v.*"))


def give_up_hosts(frontier: DataFrame, hosts: DataFrame, now: float) -> DataFrame:
    """Finish queued pages of hosts(host, outcome, reason, error), and forget what only their redirects have seen."""
    h = hosts.select("host", F.col("outcome").alias("__o"), F.col("reason").alias("__r"), F.col("error").alias("__e"))
    lost = frontier.where("state = 'queued'").join(h.select("host"), "host", "left_semi").select(F.col("url").alias("seen_from"))
    seen = frontier.where("state = 'seen'").join(lost, "seen_from", "left_anti").select(*frontier.columns)
    hit = F.col("__o").isNotNull() & (F.col("state") == "queued")
    joined = frontier.where("state != 'seen'").join(h, "host", "left").withColumns(
        {"state": F.when(hit, F.col("__o")).otherwise(F.col("state")), "reason": F.when(hit, F.col("__r")).otherwise(F.col("reason")), "error": F.when(hit, F.col("__e")).otherwise(F.col("error")), "finished_at": F.when(hit, F.lit(now)).otherwise(F.col("finished_at"))}
    )
    return joined.select(*frontier.columns).unionByName(seen)


def state_counts(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("state").agg(F.count(F.lit(1)).alias("pages"))


def unsaved(frontier: DataFrame) -> DataFrame:
    """Finished pages that weren't saved, with the host limit's and the redirects' left out; ordered as they finished."""
    return frontier.where(F.col("state").isin(*UNSAVED)).select("url", F.col("state").alias("outcome"), "reason", "status", "error", "finished_at", "seq").orderBy("finished_at", "seq").drop("finished_at", "seq")


def upsert_latest(stored: DataFrame, batch: DataFrame, key: str | Sequence[str] = "url", order: str = "seq") -> DataFrame:
    """stored and batch with one row a key, the latest: an aggregate of one struct, no sort."""
    both = stored.unionByName(batch.select(*stored.columns))
    return both.groupBy(*([key] if isinstance(key, str) else key)).agg(F.max_by(F.struct(*stored.columns), order).alias("row")).select("row.*")
