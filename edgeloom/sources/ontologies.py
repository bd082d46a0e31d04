"""OBO 1.2 files as tables: one text record per stanza, parsed with array functions.

An ontology is a few ten megabytes, so a file is read whole and cut at empty lines,
whichever line ends it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def _stanzas(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_replace("value", "\r\n?", "\n"), r"\n[ \t]*\n\s*")).alias("value"))
    return df.select(F.split(T.strip(F.col("value")), "\n").alias("lines"))


def _values(tag: str) -> Column:
    """All values of a tag in a stanza, without comments and modifiers."""
    mine = F.filter("lines", lambda x: x.startswith(f"{tag}: "))
    return F.transform(mine, lambda x: T.strip(F.regexp_replace(F.substring(x, len(tag) + 3, 2**31 - 1), r"\s*(?:!.*|\{[^}]*\}\s*(?:!.*)?)$", "")))


def _text(tag: str) -> Column:
    mine = F.filter("lines", lambda x: x.startswith(f"{tag}: "))
    return F.get(F.transform(mine, lambda x: T.strip(F.substring(x, len(tag) + 3, 2**31 - 1))), 0)


def check_version(spark: SparkSession, path: str, wanted: str = "1.2") -> None:
    """Raises ValueError unless the file says it has the wanted format version."""
    lines = [r[0] for r in spark.read.text(path).where(F.col("value").startswith("format-version:")).limit(1).collect()]
    if not lines or lines[0].split(":")[1].strip() != wanted:
        raise ValueError(f"format version {wanted} is needed")


def read_gene_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms, edges, alt_ids); edges are is_a and part_of, other relationships are left out."""
    check_version(spark, path)
    rows = _stanzas(spark, path).where(F.array_contains("lines", "[Term]"))
    obsolete = F.coalesce(F.lower(_text("is_obsolete")) == "true", F.lit(False))
    parts = F.transform(F.filter(_values("relationship"), lambda x: x.startswith("part_of ")), lambda x: F.regexp_extract(x, r"^part_of\s+(\S+)", 1))
    is_a = F.transform(_values("is_a"), lambda x: F.regexp_extract(x, r"^(\S+)", 1))
    rows = rows.select(F.get(_values("id"), 0).alias("id"), _text("name").alias("name"), F.get(_values("namespace"), 0).alias("namespace"), obsolete.alias("is_obsolete"), is_a.alias("is_a"), parts.alias("part_of"), _values("alt_id").alias("alt"))
    edge = lambda c: rows.select(F.col("id").alias("child"), F.explode(c).alias("parent"), F.lit(c).alias("rel"))
    return rows.select("id", "name", "namespace", "is_obsolete"), edge("is_a").unionByName(edge("part_of")), rows.select(F.explode("alt").alias("alt"), "id")


def read_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms(id, name, is_obsolete), alt_ids) of a plain controlled vocabulary."""
    rows = _stanzas(spark, path).where(F.array_contains("lines", "[Term]"))
    rows = rows.select(F.get(_values("id"), 0).alias("id"), _text("name").alias("name"), F.coalesce(F.lower(_text("is_obsolete")) == "true", F.lit(False)).alias("is_obsolete"), _values("alt_id").alias("alt"))
    return rows.drop("alt"), rows.select(F.explode("alt").alias("alt"), "id")
