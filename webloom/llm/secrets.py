r"""Secrets in texts: known forms, and strings that look random.

Known forms are assignments to names like password, access keys, and long hexadecimal strings. Besides,
runs of 20 and more letters, digits and +/_=- that hold letters and digits both, or letters of both cases,
or are base-32 (by chance such strings hold no digit) are put to a battery
of tests for randomness over the alphabet of the encoding they seem to be in: chi-squared uniformity
(Wilson-Hilferty's approximation), runs above and below the middle, and serial correlation. Fisher's
method makes one p-value of the three (of the hypothesis "random"). Text-like strings have small ones; random strings'
are spread evenly, so strings must have 1 / length at least, and that is the rate at which random ones are missed: shorter strings,
which the tests can hardly tell apart, need a larger p-value.

False reports are controlled per octave of length. Of the strings with a p-value from a limit up, as many are random as an
even spread says, given how many lie above one half, where text hardly comes; the others are false reports.
The limit is raised until their share is FDR at most, as far as two standard errors of that reckoning show it.

All of it is made of SQL functions. Positions are code points; they come from the lengths of what lies
between matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import unused, written

# Forms of secrets, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Runs that are tested: with letters and digits, with letters of both cases, or base-32.
KEYLIKE = r"^(?:(?=.*[0-9])(?=.*[A-Za-z])|(?=.*[a-z])(?=.*[A-Z])|(?=.*[A-Z])[A-Z2-7]+=*$)"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE = 6
#: Share of strings that aren't random among the reported, per octave of length.
FDR = 0.1
#: Steps of p-values that a limit may lie at.
BINS = 50
#: Spans that are numbered in one go, so that listing n of them copies n * _CHUNK references, not n * n.
_CHUNK = 256
MASK = "[SECRET]"
_HEX_DIGITS = "0123456789abcdef"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (form, alphabet): the first form that a string has is its inferred encoding.
ENCODINGS = (
    ("^[0-9a-f]+$", _HEX_DIGITS),
    ("^[0-9A-F]+$", _HEX_DIGITS.upper()),
    ("^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("^[A-Za-z0-9]+$", _UPPER + _UPPER.lower() + "0123456789"),
    ("^[A-Za-z0-9+/]+=*$", _UPPER + _UPPER.lower() + "0123456789+/"),
    ("^.*$", _UPPER + _UPPER.lower() + "0123456789-_=+/"),
)
_SPANS = "array<struct<start:bigint,ord:int,stop:bigint>>"


def _located(found: str, between: str, ord_: int) -> Column:
    """array<struct<start, ord, stop, text>> of matches, from them and the parts between them."""
    span = "struct<start:bigint,ord:int,stop:bigint,text:string>"
    return F.expr(
        f"""case when size({found}) > 0 then transform(array(zip_with({found}, slice({between}, 1, size({found})), (m, b) -> struct(m as m, length(b) as gap))), every ->
              aggregate(
                transform(sequence(0, (size(every) - 1) div {_CHUNK}), c -> slice(every, c * {_CHUNK} + 1, {_CHUNK})),
                struct(0L as pos, cast(array() as array<array<{span}>>) as done),
                (a, chunk) -> aggregate(chunk, struct(a.pos as pos, cast(array() as array<{span}>) as own),
                  (s, x) -> struct(s.pos + x.gap + length(x.m) as pos,
                                   concat(s.own, array(struct(s.pos + x.gap as start, {ord_} as ord, s.pos + x.gap + length(x.m) as stop, x.m as text))) as own),
                  s -> struct(s.pos as pos, concat(a.done, array(s.own)) as done)),
                a -> flatten(a.done)))[0]
            else cast(array() as array<{span}>) end"""
    )


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, within 2e-4 (a logistic approximation)."""
    return 1 / (1 + F.exp(F.least(F.greatest(1.5976 * z + 0.07056 * z * z * z, F.lit(-40.0)), F.lit(600.0))))


def p_random(text: Column) -> Column:
    """Fisher's p-value of the three tests of text's letters, under: drawn evenly from its alphabet."""
    alphabet = F.lit(None).cast("string")
    for form, letters in reversed(ENCODINGS):
        alphabet = F.when(text.rlike(form), F.lit(letters)).otherwise(alphabet)

    def tests(letters: Column) -> Column:
        bare = F.rtrim(text, F.lit("="))
        bare = F.when(F.length(bare) > 1, bare).otherwise(text)
        values = F.transform(F.split(bare, ""), lambda c: F.instr(letters, c) - 1)
        return F.aggregate(F.array(F.struct(values.alias("v"), F.length(letters).cast("double").alias("a"))), F.lit(0.0), lambda acc, s: _battery(s["v"], s["a"]))

    return F.aggregate(F.array(alphabet), F.lit(0.0), lambda acc, letters: tests(letters))


def _battery(v: Column, a: Column) -> Column:
    n = F.size(v).cast("double")
    square = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda s, x: s + F.pow(F.size(F.filter(v, lambda y: y == x)).cast("double"), F.lit(2.0)))
    chi, df = a / n * square - n, a - 1
    z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    middle = (a - 1) / 2
    start = F.struct(F.lit(0.0).alias("runs"), F.lit(0.0).alias("lagged"), F.lit(None).cast("double").alias("last"))

    def step(s: Column, x: Column) -> Column:
        d = x - middle
        turned = s["last"].isNull() | ((s["last"] > 0) != (d > 0))
        return F.struct((s["runs"] + turned.cast("double")).alias("runs"), (s["lagged"] + F.coalesce(s["last"] * d, F.lit(0.0))).alias("lagged"), d.alias("last"))

    def combined(s: Column) -> Column:
        z_runs = (s["runs"] - (n + 1) / 2) / F.sqrt(F.greatest(n - 1, F.lit(1.0)) / 4)
        z_lag = s["lagged"] / ((a * a - 1) / 12) / F.sqrt(F.greatest(n - 1, F.lit(1.0)))
        p = [_tail(z_chi), 2 * _tail(F.abs(z_runs)), 2 * _tail(F.abs(z_lag))]
        half = -(F.log(p[0]) + F.log(F.least(p[1], F.lit(1.0))) + F.log(F.least(p[2], F.lit(1.0))))
        return F.exp(-half) * (1 + half + half * half / 2)

    return F.aggregate(v, start, step, combined)


def _with_finds(documents: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """documents with columns for the text (null: empty), its base spans, and its runs (spans with octave and p), and their names.

    The overlap of runs with base spans takes time in proportion to their product.
    """
    every = unused(documents, *["find"] * 15)
    names = dict(zip(("text", "base", "runs"), every, strict=False))
    found, between, spans = every[3:7], every[7:11], every[11:15]
    forms = (ASSIGN, ACCESS, HEX, RUN)
    df = documents.withColumn(names["text"], F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.select("*", *[F.regexp_extract_all(names["text"], F.lit(form), F.lit(0)).alias(m) for m, form in zip(found, forms, strict=True)])
    df = df.select("*", *[F.when(F.size(m) > 0, F.split(names["text"], form, -1)).alias(b) for m, b, form in zip(found, between, forms, strict=True)])
    df = df.select("*", *[_located(m, b, k).alias(s) for k, (m, b, s) in enumerate(zip(found, between, spans, strict=True))])
    base = F.concat(F.filter(spans[0], lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= MIN_VALUE), spans[1], spans[2])
    df = df.withColumn(names["base"], F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["stop"].alias("stop")))))
    own = F.filter(spans[3], lambda s: s["text"].rlike(KEYLIKE) & ~F.exists(names["base"], lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    runs = F.transform(
        own,
        lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["stop"].alias("stop"), F.floor(F.log2((s["stop"] - s["start"]).cast("double"))).cast("int").alias("octave"), p_random(s["text"]).alias("p")),
    )
    return df.withColumn(names["runs"], runs).select(*documents.columns, *names.values()), names


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(p * BINS)).cast("int")


def _large_enough(s: Column) -> Column:
    return s["p"] * (s["stop"] - s["start"]) >= 1


def report_from(runs: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """runs(start, stop, octave, p) -> {octave: bin}: strings whose p-value is in this bin or above are reported.

    Made of a histogram, at most BINS rows an octave. BINS where no limit would do.
    """
    r = F.struct("start", "stop", "p")
    bins = runs.where(_large_enough(r)).groupBy("octave", _bin(F.col("p")).alias("bin")).count()
    octave = Window.partitionBy("octave")
    up = octave.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    high = F.sum(F.when(F.col("bin") * 2 >= BINS, F.col("count")).otherwise(0)).over(octave)
    random = 2 * (high + 2 * F.sqrt(high) + 1) * (1 - F.col("bin") / BINS)
    held = bins.select("octave", "bin", F.sum("count").over(up).alias("reported"), random.alias("random")).where(F.col("reported") - F.col("random") <= F.lit(fdr) * F.col("reported"))
    limits = bins.select("octave").distinct().join(held.groupBy("octave").agg(F.min("bin").alias("bin")), "octave", "left")
    return {r["octave"]: BINS if r["bin"] is None else r["bin"] for r in limits.collect()}


def _random(runs: Column, limits: dict[int, int]) -> Column:
    """The spans of runs that pass."""

    def passes(s: Column) -> Column:
        at = F.lit(0)
        for octave, b in limits.items():
            at = F.when(s["octave"] == octave, F.lit(b)).otherwise(at)
        return (_bin(s["p"]) >= at) & _large_enough(s)

    return F.transform(F.filter(runs, passes), lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["stop"].alias("stop")))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["ord"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_secrets(documents: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, span_list of each document(doc_id, text).

    base_sha256 digests the known forms' spans as kind:start:end, by start, then kind, joined by commas; spans has
    all in this way; span_list has (start, ord, stop), ord counting KINDS. Null text: empty. Null, repeated and extra
    columns change nothing. Each row is judged alone but for the limits that report_from() draws from all rows' p-values.
    """
    found, at = _with_finds(documents.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")))
    found = written(found.select("doc_id", F.col(at["base"]).alias("base"), F.col(at["runs"]).alias("runs")), "secret-spans")
    limits = report_from(found.select(F.explode("runs").alias("r")).select("r.*"), fdr)
    found = found.withColumn("span_list", F.array_sort(F.concat("base", _random(F.col("runs"), limits))))
    counts = [F.size(F.filter("base", lambda s: s["ord"] == k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("span_list")).alias("spans"), "span_list")


def mask_secrets(documents: DataFrame, fdr: float = FDR, mask: str = MASK) -> DataFrame:
    """documents with each secret in text (merged where they overlap) replaced by mask, and n_chars to match.

    Columns stay as they are otherwise; a null text stays null. Texts are read twice and not shuffled: once for the p-values of
    all random-looking strings, once to mask.
    """
    columns = documents.columns
    found, at = _with_finds(documents.select(F.col("text").alias("text")))
    limits = report_from(found.select(F.explode(at["runs"]).alias("r")).select("r.*"), fdr)
    found, at = _with_finds(documents)
    spans = unused(found, "spans")[0]
    text = at["text"]
    found = found.withColumn(spans, F.array_sort(F.concat(at["base"], _random(F.col(at["runs"]), limits))))
    masked = F.expr(
        f"""case when size(`{spans}`) = 0 then text else aggregate(`{spans}`, struct('' as done, 0L as pos),
          (a, s) -> case when s.stop <= a.pos then a else struct(
              concat(a.done, case when s.start >= a.pos then concat(substring(`{text}`, cast(a.pos as int) + 1, cast(s.start - a.pos as int)), '{mask}') else '' end) as done,
              s.stop as pos) end,
          a -> concat(a.done, substring(`{text}`, cast(a.pos as int) + 1))) end"""
    )
    found = found.withColumn("text", masked)
    if "n_chars" in columns:
        found = found.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*columns)
