"""Quality rules per document and a verdict per host.

Each document is measured against rules; failures are summed by host (its source). A host's rate of
failures is shrunk towards all hosts' by a beta prior fitted to their rates, so a host of few documents
isn't condemned by one. Documents of a host whose shrunk rate is too high go, whatever they are like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import written

MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED = 30  # percent of words
#: A host goes if the mean of its failure rate's posterior is above this for any rule.
MAX_HOST_RATE = 0.5
#: Hosts' rules besides the document's own: name -> condition over the measures.
HOST_RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeated": f"100 * n_repeat_words > {MAX_REPEATED} * n_words",
    "symbols": "10 * n_symbols > 9 * n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 16 * n_words",
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACE = "\t\n\x0b\x0c\r"
_BLANKS = str.maketrans(dict.fromkeys(_SPACE, " "))
_SYMBOLS = "#*$%&|<>"


def words(text: str) -> list[str]:
    """Words between ASCII white space."""
    return [x for x in text.translate(_BLANKS).split(" ") if x]


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """MEASURES of a whole text; null: none of anything."""
    text = text or ""
    every = words(text)
    n = len(every)
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" " + _SPACE)]
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in every), np.int64, n)
    return n, sum(map(len, every)), symbols, len(lines) - len(set(lines)), repeated_words(ids)


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Positions in windows of `width` ids that occur twice or more. Exact: windows are ranked by doubling."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    rank, covered = ids, 1
    while covered < width:
        step = min(covered, width - covered)
        pair = rank[: len(rank) - step] * (len(ids) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        covered += step
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def document_measures(documents: DataFrame) -> DataFrame:
    """doc_id, host (the source) and MEASURES of each row of documents(doc_id, text, source)."""

    def measure(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = np.array([measures(x) for x in part.column("text").to_pylist()], np.int64).reshape(-1, len(MEASURES))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), *[pa.array(found[:, i]) for i in range(len(MEASURES))]], names=["doc_id", "host", *MEASURES])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(measure, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, docs, host_rate (the largest of the shrunk rates) and host_kept.

    Per rule, hosts' rates have mean m (of all documents) and variance v (over hosts, weighed by
    documents, less what sampling alone adds); the prior is the beta distribution with these, its
    strength m(1-m)/v - 1 kept in [1, 1000]. One row per host goes into the fit; documents are summed first.
    """
    fails = [F.sum(F.expr(f"cast({c} as long)")).alias(r) for r, c in HOST_RULES.items()]
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *fails)
    hosts = written(hosts, "host-fails")
    fit = []
    for r in HOST_RULES:
        rate = F.col(r) / F.col("docs")
        fit += [F.sum(r).alias(f"{r}_sum"), F.sum(F.col("docs") * rate * rate).alias(f"{r}_square")]
    priors = hosts.agg(F.sum("docs").alias("all_docs"), F.count(F.lit(1)).alias("hosts"), *fit)
    found = priors.first()  # one row of sums
    docs = found["all_docs"] or 1
    shrunk = []
    for r in HOST_RULES:
        m = (found[f"{r}_sum"] or 0) / docs
        spread = m * (1 - m)
        v = (found[f"{r}_square"] or 0.0) / docs - m * m - spread * found["hosts"] / docs
        strength = max(1.0, min(1000.0, spread / v - 1)) if v > 0 else 1000.0
        shrunk.append((F.col(r) + m * strength) / (F.col("docs") + strength))
    return hosts.select("host", "docs", F.greatest(*shrunk).alias("host_rate")).withColumn("host_kept", F.col("host_rate") <= max_rate)


def judge_documents(documents: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, MEASURES, base_failed, kept, host_rate: a row per document.

    Null or empty text: no words, so it fails. Null source: a host of its own. Repeated rows count each. A
    hot host is summed before its rows are shuffled; verdicts, a row per host, are joined back.
    """
    measured = written(document_measures(documents), "measures")
    failed = F.expr(f"{HOST_RULES['few_words']} or {HOST_RULES['repeated']}")
    verdicts = host_verdicts(measured, max_rate).select(F.col("host").alias("h"), "host_rate", "host_kept")
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("h")))
    return joined.select("doc_id", *MEASURES, failed.alias("base_failed"), (~failed & F.col("host_kept")).alias("kept"), "host_rate")
