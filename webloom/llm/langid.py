"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a logistic classifier on hashed character 1- to
3-grams of the whole text predicts which side it is on. A text's language is the one whose codeword has
the least loss, summed over bits and weighed by how well each bit is learned; where two languages are
nearly as close, the answer is flagged as ambiguous.

The nearest language may still be a wrong one: a text fits it if its n-grams are about as likely there as
those of the sample's own documents, each judged by the half of the sample that it isn't in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 4096
#: Learned from a sample: so many documents of each language, as drawn by hash, of SAMPLE in all.
SAMPLE_EACH = 400
SAMPLE = 4000
NONE = "und"
AMBIGUOUS = 0.2
FOLDS, HELD_OUT = 4, 2
#: A text may be so far on the way from a language's own documents to n-grams drawn evenly. Letters drawn evenly are about half way.
FIT_SLACK = 0.35
#: At least this share of a language's own documents fits, and a short text may stray by so many standard errors.
FIT_SHARE, FIT_ERRORS = 0.95, 2.0
#: Share of n-grams that are taken to be drawn evenly.
_EVEN = 0.02
_PART = 1 << 20


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_table: np.ndarray | None = None


def features(text: str | None) -> np.ndarray | None:
    """Square roots of n-grams' shares, hashed, length 1; None if there is no letter."""
    global _table
    if _table is None:
        _table = _letters()
    counts = np.zeros(DIMENSIONS, np.float64)
    lower = (text or "").lower()
    any_letter = False
    for at in range(0, len(lower), _PART):
        codes = np.frombuffer(lower[max(0, at - 2) : at + _PART].encode("utf-32-le", "replace"), np.uint32)
        letter = _table[codes]
        any_letter |= bool(letter.any())
        c = np.where(letter, codes, 32).astype(np.uint32)
        for n in (1, 2, 3):
            if len(c) < n:
                break
            h = c[: len(c) - n + 1] * np.uint32(0x9E3779B1)
            for j in range(1, n):
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[j : len(c) - n + 1 + j] * np.uint32(0xC2B2AE3D)
            counts += np.bincount((h ^ (h >> np.uint32(16))) % DIMENSIONS, minlength=DIMENSIONS)
    if not any_letter:
        return None
    root = np.sqrt(counts)
    return (root / np.linalg.norm(root)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """n x bits of -1 and 1: all ways of parting the languages while these are few, else drawn evenly by a fixed seed."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 6:
        bits = np.array([[(k >> (i - 1)) & 1 if i else 1 for k in range(2 ** (n - 1) - 1)] for i in range(n)])
        return (2 * bits - 1).astype(np.int8)
    rng = np.random.default_rng(0)
    width = 8 * int(np.ceil(np.log2(n)))
    draws = (rng.permuted(np.tile((np.arange(n) % 2)[:, None], (1, width)), axis=0) for _ in range(50))
    best = max(draws, key=lambda m: min(int((m[i] != m[:i]).sum(axis=1).min()) for i in range(1, n)))
    return (2 * best - 1).astype(np.int8)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # of bits
    surprise: np.ndarray  # features x languages: -log of an n-gram's share
    limit: np.ndarray  # of languages: the largest mean surprise of a long text
    spread: np.ndarray  # of languages: standard deviation of n-grams' surprise

    def fits(self, x: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether rows of features are as likely in these languages as their own documents are."""
        shares = np.square(x)
        mean = np.einsum("ij,ij->i", shares, self.surprise.T[number])
        return mean <= self.limit[number] + FIT_ERRORS * self.spread[number] / np.sqrt(np.count_nonzero(x, axis=1))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language numbers, scores, ambiguous) of rows of features."""
        if not self.codes.shape[1]:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        margin = (x @ self.weights + self.bias).astype(np.float64)
        loss = np.stack([(np.logaddexp(0, -margin * code) * self.trust).sum(axis=1) for code in self.codes], axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        top = np.sort(share, axis=1)[:, ::-1]
        return loss.argmin(axis=1), top[:, 0], top[:, 0] - top[:, 1] < AMBIGUOUS


def _surprise(x: np.ndarray) -> np.ndarray:
    return -np.log((1 - _EVEN) * np.square(x).mean(axis=0) + _EVEN / DIMENSIONS)


def _own_fit(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """surprise, limit and spread of the language of these rows. One row alone sets no limit."""
    surprise = _surprise(x)
    if len(x) < 2:
        return surprise, np.inf, 0.0
    own = np.concatenate([np.square(x[a::2]) @ _surprise(x[1 - a :: 2]) for a in (0, 1)])
    middle = float(np.median(own))
    limit = max(middle + FIT_SLACK * (float(surprise.mean()) - middle), float(np.quantile(own, FIT_SHARE)))
    shares = np.square(x).mean(axis=0)
    return surprise, limit, float(np.sqrt(shares @ np.square(surprise - shares @ surprise)))


def fit(x: np.ndarray, languages: list[str], rounds: int = 200, penalty: float = 1e-5) -> Model:
    """Logistic classifiers of all bits at once, by accelerated gradient steps; languages weigh alike."""
    names = sorted(set(languages))
    codes = codewords(len(names))
    at = {k: i for i, k in enumerate(names)}
    number = np.array([at[k] for k in languages], int)
    own = [_own_fit(x[number == i]) for i in range(len(names))]
    surprise = np.stack([s for s, _, _ in own], axis=1).astype(np.float32) if own else np.zeros((DIMENSIONS, 0), np.float32)
    limits = surprise, np.array([limit for _, limit, _ in own]), np.array([s for _, _, s in own])
    if len(names) < 2:
        return Model(names, codes, np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0), np.zeros(0), *limits)
    y = codes[number].astype(np.float32)
    weight = (1 / np.bincount(number)[number]).astype(np.float32)[:, None]
    weight /= weight.sum()
    x1 = np.hstack([x, np.full((len(x), 1), 0.5, np.float32)])
    w = v = np.zeros((x1.shape[1], y.shape[1]), np.float32)
    for k in range(rounds):
        ahead = v
        pull = weight * y / (1 + np.exp(np.clip(y * (x1 @ ahead), -50, 50)))
        new = ahead + 3.0 * (x1.T @ pull - penalty * ahead)  # 4 / the largest squared length is the limit
        w, v = new, new + k / (k + 3) * (new - w)
    right = ((x1 @ w) * y > 0).astype(np.float64)
    accuracy = np.clip((weight * right).sum(axis=0), 0.51, 0.999)
    trust = np.log(accuracy / (1 - accuracy))
    return Model(names, codes, w[:-1], 0.5 * w[-1], trust / trust.mean(), *limits)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(documents: DataFrame, sample_each: int = SAMPLE_EACH, sample: int = SAMPLE) -> Model:
    """Learn from text and lang of documents(doc_id, text, lang) outside the held-out fold with a lang.

    Every lang is learned. Languages are counted over all rows, and of each about sample_each documents (fewer
    if there are many languages: `sample` in all, but 10 of each) are drawn by the hash of their id. Null ids and texts teach nothing.
    """
    lang = F.col("lang").cast("string")
    rows = documents.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang")).where((fold(F.col("doc_id")) != HELD_OUT) & lang.isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return fit(np.zeros((0, DIMENSIONS), np.float32), [])
    each = max(10, min(sample_each, sample // len(counts)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limits = documents.sparkSession.createDataFrame([(name, min(1 << 30, -(-(each << 30) // n))) for name, n in counts.items()], "lang string, limit long")

    def extract(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [(k, x) for k, x in zip(part.column("lang").to_pylist(), map(features, part.column("text").to_pylist()), strict=True) if x is not None]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([x.tobytes() for _, x in found], pa.binary())], names=["lang", "x"])

    drawn = rows.where(F.col("text").isNotNull()).join(F.broadcast(limits), "lang").where(place < F.col("limit"))
    got = drawn.select("doc_id", "text", "lang").mapInArrow(extract, "lang string, x binary").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, DIMENSIONS)
    names = got.column("lang").to_pylist()
    order = sorted(range(len(names)), key=lambda i: (names[i], x[i].tobytes()))  # the same model whatever the order of tasks
    return fit(x[order], [names[i] for i in order])


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """documents with lang_pred, lang_score, lang_ambiguous and lang_fits for each text; columns of these names are replaced.

    lang_fits is false where the text is too unlike lang_pred's own documents, so that it is in no language of
    the model. Null text or no letter: NONE, 0, true, false; so too for all texts if the model knows no language.
    """
    from pyspark.sql import types as T

    shared = documents.sparkSession.sparkContext.broadcast(model)
    documents = documents.drop("lang_pred", "lang_score", "lang_ambiguous", "lang_fits")
    schema = T.StructType([*documents.schema.fields, *T.StructType.fromDDL("lang_pred string, lang_score double, lang_ambiguous boolean, lang_fits boolean").fields])
    at_text = documents.columns.index("text")

    def run(batches: Iterator):
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(at_text).to_pylist()
                x = [features(t) for t in texts]
                some = [i for i, f in enumerate(x) if f is not None] if own.languages else []
                pred, score, vague = [NONE] * len(x), [0.0] * len(x), [True] * len(x)
                fits = [False] * len(x)
                if some:
                    stacked = np.stack([x[i] for i in some])
                    number, likely, unsure = own.predict(stacked)
                    for i, k, s, a, f in zip(some, *(z.tolist() for z in (number, likely, unsure, own.fits(stacked, number))), strict=True):
                        pred[i], score[i], vague[i], fits[i] = own.languages[k], min(1.0, s), a, f
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(vague, pa.bool_()), pa.array(fits, pa.bool_())], names=[*part.schema.names, "lang_pred", "lang_score", "lang_ambiguous", "lang_fits"])

    return documents.mapInArrow(run, schema)


def predict_languages(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of each document; learned from documents outside the held-out fold.

    A null doc_id isn't held out. Repeated rows are predicted each.
    """
    model = train(documents)
    rows = documents.select(F.col("doc_id").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
