"""Readers of edge lists: path in, edge frame with a file order out."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.edges import ORDER, edge_frame, process


def read_cells(spark: SparkSession, path: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """Cells as strings c0, c1, ... with ORDER, the place in the input; gzip is read as is.

    Several files follow each other by path: Spark packs their splits in another order.
    """
    df = spark.read.csv(path, sep=sep, header=header, quote="", enforceSchema=False, inferSchema=False)
    df = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    files = sorted(df.inputFiles())
    if len(files) < 2:
        return df.withColumn(ORDER, F.monotonically_increasing_id())
    files = [re.sub("^file:/+", "file:/", f) for f in files]
    place = F.array_position(F.lit(files), F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")).cast("long")
    return df.withColumn(ORDER, F.array(place, F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))


def _plain(df: DataFrame, source: str, target: str) -> DataFrame:
    return df.select(T.clean_accession(F.col(source)).alias("source"), T.clean_accession(F.col(target)).alias("target"), F.lit(None).cast("string").alias("label"), *[F.lit(None).cast("string").alias(c) for c in ("pubmed", "experiment_type")], ORDER)


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated with a header; the first two columns."""
    return _plain(read_cells(spark, path), "c0", "c1")


def bioplex(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated with a header; the third and fourth columns."""
    return _plain(read_cells(spark, path), "c2", "c3")


def sif(spark: SparkSession, path: str) -> DataFrame:
    """`A pp B` lines without a header."""
    return _plain(read_cells(spark, path, " ", header=False), "c0", "c2")


def _uniprot_ids(c: Column) -> Column:
    """Accessions among |-separated identifiers: uniprotkb entries that aren't entry names."""
    items = F.filter(F.split(c, "[|]"), lambda x: x.contains("uniprotkb") & ~x.contains("_"))
    return F.transform(items, lambda x: F.upper(T.strip(F.regexp_replace(x, "^[^:]*:", ""))))


def innate_mitab(spark: SparkSession, path: str) -> DataFrame:
    """MITAB of InnateDB: rows between two ENSG genes, every pair of their accessions."""
    df = read_cells(spark, path).where(F.col("c2").contains("ENSG") & F.col("c3").contains("ENSG"))
    rows = df.withColumns({"source": F.explode(_uniprot_ids(F.col("c4")))}).withColumn("target", F.explode(_uniprot_ids(F.col("c5"))))
    psimi = F.nullif(F.regexp_extract("c6", 'psi-mi:"([^"]*)"', 1), F.lit(""))
    pmid = T.null_of(F.regexp_replace("c8", "^.*:", ""))
    return rows.select("source", "target", F.lit(None).cast("string").alias("label"), pmid.alias("pubmed"), psimi.alias("experiment_type"), ORDER)


def pina_mitab(spark: SparkSession, path: str) -> DataFrame:
    """MITAB of PINA2: references grouped by first-seen pmid, methods sorted; unequal lists raise."""
    last = lambda c: F.regexp_replace(c, "^.*:", "")
    df = read_cells(spark, path)
    pmids = F.transform(F.split("c8", "[|]"), lambda x: T.null_of(last(x)))
    groups = F.transform(F.split("c6", "[|]"), lambda x: T.null_of(F.upper(T.strip(F.regexp_replace(x, r"\(.*$", "")))))
    df = df.select(T.clean_accession(last(F.col("c0"))).alias("source"), T.clean_accession(last(F.col("c1"))).alias("target"), pmids.alias("p"), groups.alias("g"), ORDER)
    df = df.where("source is not null and target is not null")
    aligned = F.when(F.size("p") == F.size("g"), F.col("p")).otherwise(F.raise_error(F.lit("as many publications as methods are needed")))
    distinct = F.filter(F.array_distinct(aligned), lambda x: x.isNotNull())

    def methods(p: Column) -> Column:
        mine = F.transform(F.filter(F.arrays_zip(F.col("p").alias("p"), F.col("g").alias("g")), lambda x: x["p"] == p), lambda x: x["g"])
        return F.coalesce(T.join_or_null(F.array_sort(F.array_distinct(F.array_compact(mine))), "|"), F.lit("None"))

    return df.select("source", "target", F.lit(None).cast("string").alias("label"), T.join_or_null(distinct).alias("pubmed"), T.join_or_null(F.transform(distinct, methods)).alias("experiment_type"), ORDER)


#: A reader takes (spark, path) and gives an edge frame; add your own.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"edge_list": edge_list, "bioplex": bioplex, "sif": sif, "innate_mitab": innate_mitab, "pina_mitab": pina_mitab}


def read_network(spark: SparkSession, path: str, reader: str | Callable = "edge_list", drop_nulls=None, allow_self_edges: bool = False, allow_duplicates: bool = False, min_counts: int | None = None, merge: bool = False, exclude_labels: list[str] | None = None) -> DataFrame:
    """Read, canonicalise and process in one lazy plan."""
    raw = (READERS[reader] if isinstance(reader, str) else reader)(spark, path)
    return process(edge_frame(raw, pubmed="pubmed", experiment_type="experiment_type"), drop_nulls, allow_self_edges, allow_duplicates, exclude_labels, min_counts, merge)


def load_network(spark: SparkSession, path: str) -> DataFrame:
    """A saved network: tab-separated with a header, null tokens are null."""
    return T.normalise_nulls(spark.read.csv(path, sep="\t", header=True))


def save_network(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; nulls are written as None."""
    T.fill_nulls(df.drop(ORDER)).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="")
