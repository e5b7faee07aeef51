"""From raw documents to training windows: five stages of the llm operators.

Each stage takes the documents that its predecessor left, written as Parquet in between, and returns the
columns of documents; the last returns packed pieces. Columns but doc_id, text, lang, source and n_chars, of whatever name, go
through all stages but the last as they are; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import jaccard, langid, mixing, secrets
from webloom.llm.common import table, written
from webloom.llm.queries import packed_digest

#: Documents go whose text has no letter, is unlike the documents of its likeliest language, is nearly as likely in
#: another, or whose likeliest language is less likely than this.
LEAST_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; a null lang is filled with the prediction.

    Null, empty and letterless texts go. Repeated rows are judged each, whole texts count. Null ids teach nothing but are judged. Where
    no row has a lang, no language is known and all rows go. Columns of docs that have identify()'s names are kept.
    """
    own = {c: f"{c}{'_' * (1 + max(map(len, docs.columns)))}" for c in docs.columns if c.lower() in ("lang_pred", "lang_score", "lang_ambiguous", "lang_fits")}
    found = langid.identify(docs.withColumnsRenamed(own), langid.train(docs))
    found = found.where((F.col("lang_pred") != langid.NONE) & (F.col("lang_score") >= LEAST_SCORE) & F.col("lang_fits") & ~F.col("lang_ambiguous"))
    found = found.withColumn("lang", F.coalesce("lang", "lang_pred"))
    return found.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle similarity: that of the smallest doc_id.

    Texts without a word all stay. Rows that repeat a doc_id, or have none, are told apart by their text.
    """
    return jaccard.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; n_chars follows. A null text stays null, repeated rows stay."""
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times. Null sources are one source; a text of no word is taken once.

    Rows that share a doc_id share their copies out. Ties among documents of one size go by the hash of doc_id, then by doc_id.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training windows; a null text is its end id alone, repeated rows are packed each."""
    return packed_digest(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("pack", pack),
]

#: SQL can express neither the classifiers nor the battery of tests; tests/llm holds run() against a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
