"""The queries of this subpackage and, where SQL can express them, their SQL (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import jaccard, langid, mixing, neighbours, packing, quality, secrets, sharding, tokenfiles, warc
from webloom.llm.common import table
from webloom.llm.tokens import vocabulary

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
QUERY_STEP = 50


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where(F.col("vec_id") % QUERY_STEP == 0), "vec_id", "embedding")


def packed_digest(documents: DataFrame) -> DataFrame:
    pieces = packing.pack_documents(documents, vocabulary(WORD_VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf_dir, "documents")).drop("host_rate")


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), sharding.shard_names())


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.read_token_files(tokenfiles.write_token_files(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY)))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).drop("span_list")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix, op2_warc, op3_jaccard, op4_neighbours, op5_pack, op6_quality, op7_shard, op8_tokens, op9_secrets, op10_language)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP2 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first_id FROM p WHERE payload_bytes >= {warc.REVISIT_BYTES} GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON payload_digest = d AND payload_bytes >= {warc.REVISIT_BYTES}
"""

_OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {jaccard.WORDS} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {jaccard.WORDS - 2}), lambda i: array_to_string(ws[i:i + {jaccard.WORDS - 1}], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE c >= {jaccard.THRESHOLD} * (x.n + y.n - c) - 1e-9),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, g.class_id, coalesce(k.n, 0) AS n_links
FROM documents d JOIN (SELECT a, min(b) AS class_id FROM r GROUP BY 1) g ON g.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY 1) k ON k.a = d.doc_id
"""

_OP4 = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
z AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS norm FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) / (q.norm * c.norm) AS score
  FROM z q JOIN z c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {QUERY_STEP} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def _op6() -> str:
    w = quality.WINDOW
    rules = quality.HOST_RULES
    fails = ", ".join(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS {r}" for r, c in rules.items())
    priors = ", ".join(f"sum({r}) / sum(docs) AS {r}_m, sum(docs * ({r} / docs) * ({r} / docs)) / sum(docs) AS {r}_q" for r in rules)
    variances = ", ".join(f"{r}_m, {r}_q - {r}_m * {r}_m - {r}_m * (1 - {r}_m) * hosts / n AS {r}_v" for r in rules)
    strengths = ", ".join(f"{r}_m, CASE WHEN {r}_v > 0 THEN greatest(1.0, least(1000.0, {r}_m * (1 - {r}_m) / {r}_v - 1)) ELSE 1000.0 END AS {r}_s" for r in rules)
    rates = ", ".join(f"({r} + {r}_m * {r}_s) / (docs + {r}_s)" for r in rules)
    return f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(ws) - {w - 2})) AS i, ws FROM w WHERE len(ws) >= {w}),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + {w - 1}], ' ') AS win FROM x),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM k),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM c, range({w}) o(o) WHERE n > 1 GROUP BY 1),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
m AS (SELECT l.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM l LEFT JOIN rep USING (doc_id)),
h AS (SELECT source, count(*) AS docs, {fails} FROM m GROUP BY 1),
a AS (SELECT sum(docs) AS n, count(*) AS hosts, {priors} FROM h),
v AS (SELECT {variances} FROM a),
s AS (SELECT {strengths} FROM v),
g AS (SELECT source, greatest({rates}) <= {quality.MAX_HOST_RATE} AS host_kept FROM h, s),
j AS (SELECT m.*, ({rules["few_words"]} OR {rules["repeated"]}) AS base_failed, host_kept FROM m JOIN g ON m.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept FROM j
"""


def _op7() -> str:
    listed = ", ".join(map(str, sharding.lookup_table(sharding.shard_names())))
    return f"""
WITH t AS (SELECT [{listed}] AS shards),
k AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, CAST(shards[slot + 1] AS INTEGER) AS shard FROM k, t
"""


ORACLE_SQL = {"op2_warc": _OP2, "op3_jaccard": _OP3, "op4_neighbours": _OP4, "op6_quality": _op6(), "op7_shard": _op7()}
