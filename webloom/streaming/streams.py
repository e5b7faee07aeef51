"""The same operators over streams: parsing, deduplication, windows and per-host state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.functions import urls
from webloom.operators import pages
from webloom.operators.errors import is_failure
from webloom.operators.politeness import Breaker, Circuit


def page_stream(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """Fetched pages as Parquet files arrive; the number of files a batch is the backpressure."""
    return spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", max_files).parquet(path)


def parse_stream(stream: DataFrame) -> DataFrame:
    return pages.parse_pages(stream)


def first_seen(stream: DataFrame, url: str = "url", at: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each queue form once; with a time column, state is dropped once the watermark has passed it."""
    keyed = stream.withColumn("form", urls.queue_form(F.col(url)))
    if at is None:
        return keyed.dropDuplicates(["form"])
    return keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(["form"])


def outcome_windows(stream: DataFrame, at: str = "ts", size: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Requests and failures of each host per window; later answers are left out."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    failed = is_failure(F.col("error_class"), F.col("status"))
    return stream.withWatermark(at, late).groupBy(window.alias("w"), "host").agg(F.count(failed).alias("requests"), F.count_if(failed).alias("failures")).select("w.start", "w.end", "host", "requests", "failures")


_STATE = "state string, opened_at double, opened int, rejected int, probe long, t array<double>, call array<long>, failed array<boolean>"


def breaker_stream(stream: DataFrame, rules: Breaker = Breaker()) -> DataFrame:
    """Circuit states of hosts over stream(host, t, call_id, error_class, status); a host's state lives on between batches.

    Rows of a batch are taken in order of t, which batches follow too.
    """
    judged = stream.select("host", "t", "call_id", is_failure(F.col("error_class"), F.col("status")).alias("failed"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        circuit = Circuit(rules)
        if state.exists:
            kept = state.get
            circuit.state, circuit.opened_at, circuit.opened, circuit.rejected = kept[:4]
            circuit.probe = None if kept[4] is None or kept[4] < 0 else kept[4]
            circuit.calls.update((call, (t, bool(f))) for t, call, f in zip(*kept[5:], strict=True))
            circuit.failures = sum(f for _, f in circuit.calls.values())
        out = []
        for t, call, failed in pd.concat(list(frames)).sort_values(["t", "call_id"])[["t", "call_id", "failed"]].itertuples(index=False):
            ok = circuit.admit(t, call)
            if ok:
                circuit.record(t, call, None if failed is None or pd.isna(failed) else bool(failed))
            out.append((key[0], t, call, ok, circuit.state, circuit.opened))
        calls = list(circuit.calls)
        times, failures = ([c[i] for c in circuit.calls.values()] for i in (0, 1))
        state.update((circuit.state, float(circuit.opened_at), circuit.opened, circuit.rejected, -1 if circuit.probe is None else int(circuit.probe), times, calls, failures))
        yield pd.DataFrame(out, columns=["host", "t", "call_id", "admitted", "state", "times_opened"])

    return judged.groupBy("host").applyInPandasWithState(step, "host string, t double, call_id long, admitted boolean, state string, times_opened int", _STATE, "append", GroupStateTimeout.NoTimeout)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str):
    """Write page records of a stream into an upserted Parquet table, a batch at a time."""
    from webloom.sources.tables import upsert_parquet

    def write(batch: DataFrame, _: int) -> None:
        upsert_parquet(batch.sparkSession, batch, path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
