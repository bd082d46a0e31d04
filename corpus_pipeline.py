"""A corpus pipeline over the documents table: rules, near-dedup, redaction, mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. In every stage documents without text are empty, documents
without an id are ordinary rows, repeated rows are rows like others until near-dedup leaves
one of them, empty tables give no rows and other columns pass through.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import mixing, packing, pii, quality, similar
from edgeloom.llm.common import cut, shared_dir
from edgeloom.llm.queries import tokenizer_path

#: Not expressible in SQL (fingerprint components, tokenizer, bin packing); tested against brute force.
ORACLE_SQL = None


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars, where there is such a column, following the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules or the likelihood ratio go."""
    trusted = quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, trusted).where("kept").select("document.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: SimHash fingerprints of 5-word shingles,
    joined by the trie down to a similarity of 0.8."""
    return similar.keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes [EMAIL], [IP], [CARD] or [PHONE]; null texts stay null."""
    found = pii.find(docs)
    text = pii.redact(F.col("text"), {k: F.col(f"{k}_spans") for k in pii.KINDS})
    text = F.when(F.col("document.text").isNotNull(), text)
    return _measured(found.select(*[text.alias(c) if c == "text" else F.col("document").getField(c).alias(c) for c in docs.columns]), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its source's target asks for."""
    mixed = cut(mixing.mix(docs).select("doc_id", "text_hash", "copies", "part"))
    return _measured(mixing.apply_mix(docs, mixed), docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in windows of 4096."""
    return packing.pack(docs, tokenizer_path(), window=4096, end_id=2, keep={"ids_crc32": F.crc32("ids")})


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents table; each stage is written and read again.

    What a stage has read is removed once its own rows are written whole.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{top}/{k}")
            docs = spark.read.parquet(f"{top}/{k}")
            if k:
                old = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{k - 1}")
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
