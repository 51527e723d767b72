"""The queries of the training-data operators over ``documents``, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import exact_dedup, language, mixing, ngram, packing, pii, quality, secrets, sharding, simhash
from ..session import spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score_corpus(documents(spark, sf_dir)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"
    )


def op2_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op3_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law: rows."""
    found = sharding.stratified_shards(documents(spark, sf_dir))
    return found.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language.identify(docs, language.learn(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op7_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    return found.select("doc_id", *pii.counts("base"), F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_zstd_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(documents(spark, sf_dir)).drop("text_hash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_kneser_ney, op2_genetic_packing, op3_stratified_shards, op4_weak_supervision, op5_simhash_near_dedup,
        op6_byte_network, op7_bootstrapped_pii, op8_zstd_secrets, op9_exact_dedup, op10_pfair_mix,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


#: Without null ids or repeated rows, of which the tests take care.
_OP9 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


#: CRC-32 by its table, which is made from the polynomial (3988292384); then ranks and fractions as in the operator's first lines.
_OP3 = """
WITH remainders AS (SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(0, 256) r(i))),
hexed AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, source, n, list_transform(range(0, n), lambda k: CAST(('0x' || substr(h, 2 * k + 1, 2)) AS BIGINT)) AS b FROM hexed),
summed AS (SELECT doc_id, source, n + 16 AS size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, remainders),
keyed AS (SELECT *, coalesce('=' || source, 'null') AS s, sha1('17|' || doc_id) AS key FROM summed),
placed AS (SELECT *, (2 * (row_number() OVER (PARTITION BY s ORDER BY key, doc_id) - 1) + 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY s))::DOUBLE AS f FROM keyed),
line AS (SELECT *, row_number() OVER (ORDER BY f, s, key, doc_id) - 1 AS pos, count(*) OVER () AS total FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos * 40 // total AS INTEGER) AS shard, pos - ((pos * 40 // total) * total + 39) // 40 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM line
"""

#: One period is walked slot by slot: k has the blocks that each source has had.
_OP10 = """
WITH RECURSIVE keyed AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS s, sha1('23|' || doc_id) AS key FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY key, doc_id) - 1 AS r FROM keyed),
sizes AS (SELECT s, count(*) AS n FROM ranked GROUP BY s),
weights AS (SELECT s, n, pow(n / sum(n) OVER (), 0.9::DOUBLE) AS w, count(*) OVER () AS m FROM sizes),
exact AS (SELECT s, n, w / sum(w) OVER () * (10000 - m) AS x FROM weights),
shares AS (SELECT s, n, 1 + floor(x)::BIGINT + CASE WHEN row_number() OVER (ORDER BY floor(x) - x, s) <= 10000 - sum(1 + floor(x)::BIGINT) OVER () THEN 1 ELSE 0 END AS a FROM exact),
listed AS (SELECT list(a ORDER BY s) AS a, list(s ORDER BY s) AS names FROM shares),
walk(slot, k, pick) AS (
    SELECT -1::BIGINT, list_transform(a, lambda x: 0::BIGINT), 0::BIGINT FROM listed
    UNION ALL SELECT slot + 1, list_transform(k, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END), p FROM (
        SELECT slot, k, list_min(list_filter(list_transform(a, lambda w, i: {'d': ((k[i] + 1) * 10000 + w - 1) // w, 'w': -w, 'i': i, 'r': k[i] * 10000 // w}), lambda x: x.r <= slot + 1)).i AS p
        FROM walk, listed WHERE slot < 9999)),
slots AS (SELECT names[pick] AS s, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS j FROM walk, listed WHERE slot >= 0),
ends AS (SELECT max(((n + 15) // 16 - 1) // a * 10000 + slots.slot) AS last FROM shares JOIN slots ON slots.s = shares.s AND slots.j = ((n + 15) // 16 - 1) % a),
turns AS (SELECT doc_id, source, s, a, n, r, last, unnest(range(0, ((last // 10000 + 1) * a * 16) // n + 1)) AS epoch FROM ranked JOIN shares USING (s), ends),
dealt AS (SELECT doc_id, source, s, a, r + epoch * n AS rank, epoch, last FROM turns),
put AS (SELECT doc_id, source, epoch, rank // 16 AS block, rank % 16 AS within, rank // 16 // a * 10000 + slots.slot AS slot, a, last FROM dealt JOIN slots ON slots.s = dealt.s AND slots.j = rank // 16 % a)
SELECT doc_id, source, epoch, block, block * 10000 // a AS release, ((block + 1) * 10000 + a - 1) // a AS deadline, slot, row_number() OVER (ORDER BY slot, within) - 1 AS position FROM put WHERE slot <= last
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_stratified_shards": _OP3, "op9_exact_dedup": _OP9, "op10_pfair_mix": _OP10}
