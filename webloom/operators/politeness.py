"""How fast and how often hosts are asked: schedules, slowdowns, retries, circuit breakers, proxies.

What has a closed form is a window; what depends on its own past decisions is a fold over a host's
events in time order, which come in batches: a task holds one batch and one host's state.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators.errors import is_failure, kind

MIN_SLOWDOWN, MAX_SLOWDOWN, HALF_LIFE = 1.0, 60.0, 60.0
RATE_WINDOW = 5.0
MAX_TIMEOUT_GROWTH = 4.0
SITEMAP_TIMEOUT = 10.0


def folded(df: DataFrame, order: list[str], begin: Callable, schema: str) -> DataFrame:
    """df's rows, of one key (its first column) after the other, each in order, as the key's step() makes them anew.

    begin() gives a key's step; it gets a row's values and returns the new row. However many rows a key has, they aren't held together.
    """
    key = df.columns[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, step = None, None
        for rows in batches:
            made = []
            for row in rows.itertuples(index=False, name=None):
                if step is None or row[0] != own:
                    own, step = row[0], begin()
                made.append(step(*row))
            yield pd.DataFrame(made, columns=names)

    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    return df.withColumn(key, F.col(key).cast("string")).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


# Schedules


def interval_of(rate: float | None, min_delay: float = 0.0) -> float:
    """Seconds between requests to a host."""
    return max(1 / rate if rate else 0.0, min_delay)


def scheduled_starts(requests: DataFrame, interval: Column, key: str = "host", at: str = "ts", order: str | None = None) -> DataFrame:
    """requests with start: each as soon as it has come and `interval` after its predecessor of the key.

    start(n) = max(arrival(n), start(n - 1) + i) is  max over m <= n of arrival(m) - m i,  plus n i.
    """
    by = Window.partitionBy(key).orderBy(*([at] if order is None else [at, order]))
    n = F.row_number().over(by).cast("double")
    df = requests.withColumn("__n", n).withColumn("__i", interval)
    free = F.max(F.col(at) - F.col("__n") * F.col("__i")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("start", free + F.col("__n") * F.col("__i")).drop("__n", "__i")


def gaps(requests: DataFrame, key: str = "host", at: str = "start") -> DataFrame:
    """requests with gap: seconds since the key's request before."""
    return requests.withColumn("gap", F.col(at) - F.lag(at).over(Window.partitionBy(key).orderBy(at)))


def rate_stats(requests: DataFrame, now: float, started: float, key: str = "host", at: str = "start") -> DataFrame:
    """One row: requests, current_rps over the last seconds, avg_delay between requests of a host."""
    span = min(RATE_WINDOW, max(now - started, 1.0))
    return gaps(requests, key, at).agg(
        F.count(F.lit(1)).alias("requests"), (F.count_if((F.col(at) > now - RATE_WINDOW) & (F.col(at) <= now)) / F.lit(span)).alias("current_rps"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("avg_delay")
    )


def busiest_span(requests: DataFrame, seconds: float, at: str = "t") -> DataFrame:
    """One row over all requests (at counts microseconds): most, the requests of a span that ends with one, and total of all such counts.

    Time is cut into blocks of at least a span; a block also gets its predecessor's last requests, so no task holds all.
    """
    span = int(seconds * 1_000_000)
    block = max(span, 3_600_000_000)
    own = requests.select(F.col(at).alias("t"), F.expr(f"({at} - pmod({at}, {block})) div {block}").alias("block"), F.lit(True).alias("own"))
    lead = own.where(F.pmod("t", F.lit(block)) >= block - span).withColumns({"block": F.col("block") + 1, "own": F.lit(False)})
    w = Window.partitionBy("block").orderBy("t").rangeBetween(-span + 1, 0)
    return own.unionByName(lead).withColumn("n", F.count(F.lit(1)).over(w)).where("own").agg(F.max("n").alias("most"), F.sum("n").alias("total"))


def domain_rates(requests: DataFrame, key: str = "host", at: str = "start") -> DataFrame:
    return gaps(requests, key, at).groupBy(key).agg(F.count(F.lit(1)).alias("requests"), F.avg("gap").alias("avg_gap"))


def decayed(interval: Column, since: Column, now: Column) -> Column:
    """What is left of a slowdown: it halves every HALF_LIFE seconds."""
    return interval * F.pow(F.lit(0.5), (now - since) / HALF_LIFE)


def slowdowns(answers: DataFrame, base: float, key: str = "host") -> DataFrame:
    """Intervals after each 429: answers(host, sent_at, ts) -> host, sent_at, ts, grew, interval.

    An answer to a request sent before the host's last slowdown changes nothing.
    """

    def begin():
        slowed: tuple[float, float] | None = None

        def step(host, sent, ts):
            nonlocal slowed
            left = 0.0 if slowed is None else slowed[0] * 0.5 ** ((ts - slowed[1]) / HALF_LIFE)
            current = max(base, left)
            wanted = min(MAX_SLOWDOWN, max(2 * current, MIN_SLOWDOWN))
            grew = (slowed is None or sent >= slowed[1]) and wanted > current
            if grew:
                slowed, current = (wanted, ts), wanted
            return host, sent, ts, grew, current

        return step

    return folded(answers.select(key, "sent_at", "ts"), ["ts", "sent_at"], begin, f"{key} string, sent_at double, ts double, grew boolean, interval double")


def holds(penalties: DataFrame, key: str = "host") -> DataFrame:
    """Until when each host is held, and why: the longest of penalties(host, at, seconds, reason)."""
    until = F.col("at") + F.col("seconds")
    return penalties.groupBy(key).agg(F.max(until).alias("next_allowed_at"), F.max_by("reason", until).alias("hold_reason"))


def crawl_delays(delays: DataFrame, key: str = "host") -> DataFrame:
    """A host's delay never goes down."""
    return delays.groupBy(key).agg(F.max("delay").alias("interval"))


# Retries


@dataclass(frozen=True)
class RetryPolicy:
    max_retries: int = 3
    factor: float = 2.0
    base_delay: float = 1.0
    max_delay: float = 30.0
    #: status or error class -> (retries at most or None, delay multiplier)
    rules: tuple[tuple[int | str, int | None, float], ...] = ((500, 1, 1.0), (429, None, 4.0))

    def _rule(self, status: Column, error_class: Column, at: int, default) -> Column:
        found = F.lit(default)
        for rule in reversed(self.rules):
            hit = status == rule[0] if isinstance(rule[0], int) else error_class == rule[0]
            found = F.when(hit & F.lit(rule[at] is not None), F.lit(rule[at])).otherwise(found)
        return found

    def refusal(self, error_class: Column, status: Column, retries: Column, rule_retries: Column, retry_after: Column) -> Column:
        """Why an error isn't retried; null if it is."""
        cap = self._rule(status, error_class, 1, 10**6)
        return (
            F.when(kind(error_class) == "PermanentError", "permanent error")
            .when(~kind(error_class).isin("TransientError", "NetworkError"), "not a retried error type")
            .when(retries >= self.max_retries, "no retries left")
            .when(rule_retries >= cap, F.concat(F.lit("no retries left for HTTP "), status.cast("string")))
            .when(retry_after > self.max_delay, F.format_string(f"the server wants a wait of %.0f s, over the limit of {self.max_delay:g} s", retry_after))
        )

    def delay(self, status: Column, error_class: Column, retries: Column, retry_after: Column, draw: Column) -> Column:
        """Seconds before the next attempt; draw is uniform on [0, 1]: half of the backoff is jitter."""
        backoff = F.least(F.lit(self.max_delay), self.base_delay * self._rule(status, error_class, 2, 1.0) * F.pow(F.lit(self.factor), retries))
        return F.least(F.greatest(backoff / 2 + draw * backoff / 2, F.coalesce(retry_after, F.lit(0.0))), F.lit(self.max_delay))


def timeout_for(base: Column, retries: Column, growth: float = 1.5, sitemap: Column | None = None) -> Column:
    """Later attempts wait longer, up to four times; sitemaps ten times as long."""
    grown = base * F.least(F.pow(F.lit(growth), retries), F.lit(MAX_TIMEOUT_GROWTH))
    return grown if sitemap is None else F.when(sitemap, grown * SITEMAP_TIMEOUT).otherwise(grown)


def retry_after(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a number, or a date seen from now (epoch seconds); null if neither."""

    @F.pandas_udf("double")
    def dated(values: pd.Series) -> pd.Series:
        def moment(v: str | None) -> float | None:
            if v is None:
                return None
            try:
                at = parsedate_to_datetime(v.strip())
            except ValueError:
                return None
            return at.timestamp() if at.tzinfo else pd.Timestamp(at, tz="UTC").timestamp()

        return pd.Series([moment(v) for v in values], dtype="float64")

    digits = F.trim(value).rlike("^[0-9]+$")
    found = dated(F.when(~digits, value))
    at = F.when(~F.isnan(found), found)
    return F.when(digits, F.trim(value).cast("double")).otherwise(F.when(at.isNotNull(), F.greatest(F.lit(0.0), at - now)))


# Circuit breaker


@dataclass(frozen=True)
class Breaker:
    """A host's circuit: opens when enough of the calls in a window failed, probes once after a cooldown."""

    threshold: float = 0.5
    min_requests: int = 5
    window: float = 60.0
    cooldown: float = 30.0


class Circuit:
    """One host's state, fed with calls in time order. It holds the calls of a window, and how many of them failed."""

    def __init__(self, rules: Breaker):
        self.rules = rules
        self.state, self.opened_at, self.opened, self.rejected = "closed", 0.0, 0, 0
        self.probe = None
        self.calls: OrderedDict = OrderedDict()  # call -> (time, failed), oldest first
        self.failures = 0

    def _age(self, now: float) -> None:
        if self.state == "open" and now >= self.opened_at + self.rules.cooldown:
            self.state = "half_open"
        while self.calls:
            call, (at, failed) = next(iter(self.calls.items()))
            if at > now - self.rules.window:
                break
            del self.calls[call]
            self.failures -= failed

    def _turn(self, state: str, now: float) -> None:
        """Enter a state; what was counted before is forgotten."""
        self.calls.clear()
        self.failures, self.state = 0, state
        if state == "open":
            self.opened_at = now
            self.opened += 1

    def admit(self, now: float, call) -> bool:
        self._age(now)
        if self.state == "closed" or (call is not None and call == self.probe):
            return True
        if self.state == "half_open" and self.probe is None:
            self.probe = call
            return True
        self.rejected += 1
        return False

    def record(self, now: float, call, failed: bool | None) -> None:
        probing = call is not None and call == self.probe
        if probing:
            self.probe = None
        if failed is None:
            return
        if probing:
            self._turn("open" if failed else "closed", now)
            return
        self._age(now)
        if self.state == "closed":
            self._count(now, call, failed)

    def _count(self, now: float, call, failed: bool) -> None:
        """Add a call, or what its retry came to, and open if too many failed."""
        at, before = self.calls.get(call, (now, False))
        self.calls[call] = (at, failed)
        self.failures += failed - before
        enough = len(self.calls) >= self.rules.min_requests
        if failed and enough and self.failures >= self.rules.threshold * len(self.calls):
            self._turn("open", now)


def breaker_trace(attempts: DataFrame, rules: Breaker = Breaker(), key: str = "host") -> DataFrame:
    """attempts(host, t, call_id, error_class, status) -> with admitted, state (after it), times_opened.

    An attempt that is refused doesn't take place and its outcome doesn't count.
    """
    columns = [key, "t", "call_id"]

    def begin():
        circuit = Circuit(rules)

        def step(host, t, call, failed):
            call = None if pd.isna(call) else call
            ok = circuit.admit(t, call)
            if ok:
                circuit.record(t, call, None if pd.isna(failed) else bool(failed))
            return host, t, call, ok, circuit.state, circuit.opened

        return step

    judged = attempts.select(*columns, is_failure(F.col("error_class"), F.col("status")).alias("failed"))
    return folded(judged, ["t", "call_id"], begin, f"{key} string, t double, call_id long, admitted boolean, state string, times_opened int")


def window_failures(calls: DataFrame, seconds: float, key: str = "host", at: str = "t") -> DataFrame:
    """calls with requests and failures of the key in the window (at - seconds, at]; at counts microseconds."""
    micros = int(seconds * 1_000_000)
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-micros + 1, 0)
    return calls.withColumn("requests", F.count("failed").over(w)).withColumn("failures", F.sum(F.col("failed").cast("long")).over(w))


def debounced_failures(events: DataFrame, apart: float, key: str = "host", at: str = "t") -> DataFrame:
    """Failures of a host that count: those at least `apart` seconds after the last that did; a success starts anew."""

    def begin():
        counted, last = 0, None

        def step(host, t, ok):
            nonlocal counted, last
            if ok:
                counted, last = 0, None
            elif last is None or t - last >= apart:
                counted, last = counted + 1, t
            return host, t, counted

        return step

    return folded(events.select(key, at, "ok"), [at, "ok"], begin, f"{key} string, {at} double, counted int")


# Proxies and concurrency


def proxy_index(host: Column, proxies: int, shift: Column | None = None) -> Column:
    """The proxy of a host, moved on by its shift."""
    return F.pmod(F.crc32(host.cast("binary")) + (F.lit(0) if shift is None else shift), F.lit(proxies)).cast("int")


def proxy_runs(requests: DataFrame, max_failures: int = 3, key: str = "proxy", at: str = "t") -> DataFrame:
    """requests(proxy, t, failed) with in_a_row: failures since the last success (null failed counts neither way), and whether it is out."""
    w = Window.partitionBy(key).orderBy(at)
    block = F.sum(F.when(~F.col("failed"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = requests.withColumn("__block", block)
    row = Window.partitionBy(key, "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    run = F.coalesce(F.sum(F.col("failed").cast("long")).over(row), F.lit(0))
    return df.withColumn("in_a_row", run).withColumn("removed", F.coalesce("failed", F.lit(False)) & (F.col("in_a_row") % max_failures == 0)).drop("__block")


def proxy_stats(requests: DataFrame, max_failures: int = 3) -> DataFrame:
    return proxy_runs(requests, max_failures).groupBy("proxy").agg(F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("failures"), F.count_if("removed").alias("times_removed"))


def active_at_once(spans: DataFrame, key: str = "host", begin: str = "start", end: str = "stop") -> DataFrame:
    """The most requests of a key under way at once."""
    marks = spans.select(key, F.inline(F.array(F.struct(F.col(begin).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))))
    w = Window.partitionBy(key).orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("active", F.sum("step").over(w)).groupBy(key).agg(F.max("active").alias("most"))
