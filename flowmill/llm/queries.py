"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lm, media, minhash, packing, quality, sharding, suffix, toxicity, warc
from .common import fold, table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _judged(rows: DataFrame, parts: int, held: int) -> DataFrame:
    return rows.select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))), 5, 0)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), 1024, 2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _judged(toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))), 4, 2)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.kept_digest(suffix.cut(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash_near_dedup, op2_sharding, op3_quality_classifier, op4_best_fit_packing, op5_toxicity, op6_lm_scoring, op7_telephony_media, op8_decontamination, op9_warc, op10_suffix_dedup)
}

_BITS = [f"CAST(('0x' || substr(h, {5 * k + 1}, 5)) AS BIGINT) >> {s} & 31" for k in range(8) for s in (15, 10, 5, 0)]
_BASE32 = " || ".join(f"substr('{warc.BASE32}', CAST(({b}) AS INTEGER) + 1, 1)" for b in _BITS)

# crc32 by bytes: a table of the reflected polynomial's remainders, then one step a byte
_CRC_STEP = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_BYTES = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))"

ORACLES: dict[str, str] = {
    "op2_sharding": f"""
        WITH step AS (SELECT {_CRC_STEP} AS rest),
        sized AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size,
          CAST(xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, x: xor(c >> 8, step.rest[(xor(c, x) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32
          FROM documents, step),
        placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS reached, sum(size) OVER () AS whole FROM sized),
        dealt AS (SELECT *, CAST(least(23, (reached - size // 2 - 1) * 24 // whole) AS INTEGER) AS shard FROM placed)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM dealt""",
    "op9_warc": f"""
        WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        grouped AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS original FROM hashed)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
          CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> original THEN original END AS refers_to
        FROM grouped""",
}
