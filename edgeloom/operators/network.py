"""Sub-networks of a prediction table, by label or by pathway."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mapping import mark_members
from .reports import probability_columns

ENDS = ("protein_a", "protein_b")


def by_label(predictions: DataFrame, label: str, threshold: float) -> DataFrame:
    """Edges whose probability of the label reaches the threshold."""
    if f"{label}-pr" not in predictions.columns:
        raise ValueError(f"no predictions for {label}")
    return predictions.where(F.col(f"`{label}-pr`") >= float(threshold))


def by_pathway(predictions: DataFrame, members: list[str], threshold: float, genes: bool = False) -> DataFrame:
    """Edges with either end in members (accessions, or gene names) whose best probability reaches the threshold."""
    a, b = ("gene_a", "gene_b") if genes else ENDS
    near = predictions.where(F.col(a).isin(*members) | F.col(b).isin(*members))
    out = near.where(F.col("`max-pr`") >= float(threshold))
    if out.limit(1).count() == 0:
        raise ValueError("no edges are left")
    return out


def induce(edges: DataFrame, training: DataFrame, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) tables for a network viewer.

    nodes: name, gene_name, node_in_training; edges: source, target, name,
    edge_in_training, max-pr and label probabilities. training has source, target
    and label; with a label only edges that carry it count as training edges.
    """
    known = training.where(F.array_contains(F.split("label", ","), label)) if label else training
    pairs = known.select(F.least("source", "target").alias(ENDS[0]), F.greatest("source", "target").alias(ENDS[1]))
    ends = edges.withColumns({"lo": F.least(*ENDS), "hi": F.greatest(*ENDS)})
    marked = mark_members(ends, pairs.select(F.col(ENDS[0]).alias("lo"), F.col(ENDS[1]).alias("hi")), ["lo", "hi"], "edge_in_training")
    pr = [c for c in ["max-pr", *probability_columns(edges)] if c in edges.columns]
    table = marked.select(F.col(ENDS[0]).alias("source"), F.col(ENDS[1]).alias("target"), F.concat_ws(" pp ", *ENDS).alias("name"), "edge_in_training", *[F.col(f"`{c}`") for c in pr])
    nodes = edges.select(F.explode(F.array(F.struct(F.col(ENDS[0]).alias("name"), F.col("gene_a").alias("gene_name")), F.struct(F.col(ENDS[1]).alias("name"), F.col("gene_b").alias("gene_name")))).alias("x")).select("x.*").distinct()
    members = training.select(F.explode(F.array("source", "target")).alias("name"))
    return mark_members(nodes, members, ["name"], "node_in_training").orderBy("name"), table
