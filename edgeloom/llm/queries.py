"""The registered queries of the training-data operators, thin over the operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, media, mixing, packing, pii, quality, sharding, simhash, suffixes, tokencount
from .common import documents


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    base = {k: F.col(f"{k}_base") for k in pii.KINDS}
    every = {k: F.col(f"{k}_spans") for k in pii.KINDS}
    return found.select(
        "doc_id",
        *[F.size(base[k]).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.digest_line(base).cast("binary"), 256).alias("base_sha256"),
        pii.digest_line(every).alias("spans"),
    )


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir), digest=True)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    filters = langid.fit(docs.where(fold != 1))
    found = langid.identify(docs, filters)
    return found.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1).alias("held_out"), "lang_pred", "score")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.inspect_media(media.store_media(documents(spark, sf_dir)))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), tokenizer_path())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality.judge(documents(spark, sf_dir), trusted)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), tokenizer_path(), keep={"ids_crc32": F.crc32("ids")})
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of a table lies in the shared folder under the hash of the table's path."""
    path = sharding.map_path(spark, f"documents-{hashlib.md5(sf_dir.encode()).hexdigest()}")
    placed = sharding.shard_documents(documents(spark, sf_dir), path, shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "map_version")


#: Water-filling in closed form: sources by cap over weight, of which a prefix is clamped.
MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size, md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR))) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS sz, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER r AS k, coalesce(sum(3 * sz) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pc, coalesce(sum(w) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pw, sum(sz) OVER () AS t, sum(w) OVER () AS tw FROM s WINDOW r AS (ORDER BY sz / w, source NULLS LAST)),
f AS (SELECT min_by(t - pc, k) AS rest, min_by(tw - pw, k) AS free, min(k) AS k1 FROM o WHERE w * (t - pc) <= 3 * sz * (tw - pw)),
g AS (SELECT source, sz, CASE WHEN k < k1 THEN CAST(3 * sz AS DOUBLE) ELSE CAST(w AS DOUBLE) * CAST(rest AS DOUBLE) / CAST(free AS DOUBLE) END AS target FROM o, f),
h AS (SELECT *, CAST(round(target) AS BIGINT) AS goal, CASE WHEN sz > 0 THEN CAST(round(target) AS BIGINT) // sz ELSE 0 END AS copies FROM g),
c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, sz AS source_size, target, CAST(copies * size + greatest(0, least(size, goal - copies * sz - before)) AS BIGINT) AS taken
FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source
"""

ORACLES: dict[str, str] = {"op2_mixing": MIXING_SQL}

QUERIES = {f.__name__: f for f in (op1_simhash, op2_mixing, op3_pii, op4_suffixes, op5_langid, op6_media, op7_tokens, op8_quality, op9_packing, op10_sharding)}
