"""Accession mapping: many-to-many lookups as joins; Spark picks broadcast or shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edges import COLUMNS, ORDER, edge_frame, process


def map_edges(df: DataFrame, names: DataFrame) -> DataFrame:
    """Both ends through names(old, new): unmatched edges go, several matches multiply."""
    first = names.select(F.col("old").alias("s_old"), F.col("new").alias("s_new"))
    second = names.select(F.col("old").alias("t_old"), F.col("new").alias("t_new"))
    out = df.join(first, F.col("source") == F.col("s_old")).join(second, F.col("target") == F.col("t_old"))
    out = out.withColumns({"source": F.col("s_new"), "target": F.col("t_new")}).select(*df.columns)
    return edge_frame(out, pubmed="pubmed", experiment_type="experiment_type") if set(COLUMNS) <= set(df.columns) else out


def map_network(df: DataFrame, names: DataFrame, drop_nulls="default", allow_self_edges: bool = False, allow_duplicates: bool = False, min_counts: int | None = None, merge: bool = False) -> DataFrame:
    return process(map_edges(df, names), drop_nulls, allow_self_edges, allow_duplicates, None, min_counts, merge)


def preferred(names: DataFrame, proteins: DataFrame, unreviewed: bool = False) -> DataFrame:
    """names(old, new) whose new is a known protein: the reviewed ones of an old name if
    it has any, else the others where unreviewed is set."""
    known = names.join(proteins.select(F.col("uniprot_id").alias("new"), "reviewed"), "new")
    best = known.groupBy(F.col("old").alias("b_old")).agg(F.bool_or("reviewed").alias("b_any"))
    known = known.join(best, F.col("old") == F.col("b_old"))
    keep = F.col("reviewed") | ~F.col("b_any") if unreviewed else F.col("reviewed")
    return known.where(keep).select("old", "new").distinct()


def null_unless_reviewed(df: DataFrame, column: str, proteins: DataFrame) -> DataFrame:
    """The accession in column, or null where it is unknown or not reviewed; rows stay."""
    good = proteins.where("reviewed").select(F.col("uniprot_id").alias("p_id")).distinct()
    return df.join(good, F.col(column) == F.col("p_id"), "left").withColumn(column, F.col("p_id")).drop("p_id")


def batch_map(wanted: DataFrame, names: DataFrame, proteins: DataFrame, keep_unreviewed: bool = True, taxon_id: int | None = 9606) -> DataFrame:
    """old, new: for every wanted old the sorted distinct known accessions; none gives []."""
    good = proteins if taxon_id is None else proteins.where(F.col("taxon_id") == taxon_id)
    good = good if keep_unreviewed else good.where("reviewed")
    found = names.join(good.select(F.col("uniprot_id").alias("new")), "new", "left_semi")
    lists = found.groupBy("old").agg(F.array_sort(F.collect_set("new")).alias("new"))
    return wanted.select("old").distinct().join(lists, "old", "left").withColumn("new", F.coalesce("new", F.array().cast("array<string>")))


def lookup_proteins(wanted: DataFrame, proteins: DataFrame, taxon_id: int | None = None) -> DataFrame:
    """wanted(uniprot_id) left-joined to proteins; the taxon is part of the match."""
    mine = proteins if taxon_id is None else proteins.where(F.col("taxon_id") == taxon_id)
    return wanted.join(mine.withColumnRenamed("uniprot_id", "p_uniprot"), F.col("uniprot_id") == F.col("p_uniprot"), "left").drop("p_uniprot")


def lookup_interactions(pairs: DataFrame, interactions: DataFrame, taxon_id: int | None = None) -> DataFrame:
    """pairs(source, target) left-joined to interactions, as directed pairs."""
    mine = interactions if taxon_id is None else interactions.where(F.col("taxon_id") == taxon_id)
    return pairs.join(mine, ["source", "target"], "left")


def invert(names: DataFrame) -> DataFrame:
    """new -> old, without an `up:` prefix of the accession."""
    return names.select(F.col("new").alias("old"), F.regexp_replace("old", "^up:", "").alias("new"))


def reverse_last(names: DataFrame, order: str = ORDER) -> DataFrame:
    """new -> the last old in order; for one-to-one labels of results."""
    return names.groupBy("new").agg(F.max_by("old", order).alias("old"))


def enrich(df: DataFrame, column: str, names: DataFrame, key: str, value: str, alias: str) -> DataFrame:
    """df with value of names looked up by column; names has one row per key."""
    side = names.select(F.col(key).alias("e_key"), F.col(value).alias(alias))
    return df.join(side, F.col(column) == F.col("e_key"), "left").drop("e_key")


def mark_members(df: DataFrame, members: DataFrame, on: list[str], alias: str) -> DataFrame:
    """df with a boolean: whether its `on` columns occur in members."""
    side = members.select(*[F.col(c).alias(f"m_{c}") for c in on]).distinct().withColumn(alias, F.lit(True))
    match = [F.col(c) == F.col(f"m_{c}") for c in on]
    return df.join(side, match, "left").drop(*[f"m_{c}" for c in on]).withColumn(alias, F.coalesce(alias, F.lit(False)))
