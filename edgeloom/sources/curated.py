"""Curated sources: HPRD modifications, pathway relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.edges import ORDER, concat, edge_frame, process
from ..operators.mapping import map_edges, null_unless_reviewed, preferred
from .edgelists import read_cells

#: The fields of the two file formats, in order.
PTM_FIELDS = ["substrate_hprd_id", "substrate_gene_symbol", "substrate_isoform_id", "substrate_refseq_id", "site", "residue", "enzyme_name", "enzyme_hprd_id", "modification_type", "experiment_type", "reference_id"]
XREF_FIELDS = ["hprd_id", "gene_symbol", "nucleotide_accession", "protein_accession", "entrezgene_id", "omim_id", "swissprot_id", "main_name"]
#: Relations and entries of a pathway that make edges, and labels left out.
LINKS = ("PCrel", "PPrel", "ECrel", "GGrel")
ENTRY_TYPES = ("group", "gene", "enzyme")
PATHWAY_EXCLUDED = ["Missing-interaction", "Indirect-effect", "Expression", "Repression", "Compound", "Hidden-compound"]


def read_modifications(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Modification records; experiment types and references become arrays."""
    df = read_cells(spark, path, header=header)
    df = df.toDF(*PTM_FIELDS, ORDER).withColumns({"experiment_type": T.split_cell(F.col("experiment_type"), ";"), "reference_id": F.filter(F.transform(F.split("reference_id", ","), T.strip), lambda x: ~T.is_missing(x))})
    return df.withColumns({c: T.null_of(F.col(c)) for c in PTM_FIELDS if c not in ("experiment_type", "reference_id")})


def read_xrefs(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Cross references by hprd_id, accessions as an array; the last row of an id wins."""
    df = read_cells(spark, path, header=header).toDF(*XREF_FIELDS, ORDER)
    last = df.groupBy("hprd_id").agg(F.max_by(F.struct(*[c for c in XREF_FIELDS if c != "hprd_id"]), ORDER).alias("x"))
    return last.select("hprd_id", "x.*").withColumn("swissprot_id", T.split_cell(F.col("swissprot_id")))


def modification_network(modifications: DataFrame, xrefs: DataFrame, proteins: DataFrame, drop_nulls="default", allow_self_edges: bool = False, allow_duplicates: bool = False, exclude_labels: list[str] | None = None, min_counts: int | None = None, merge: bool = False) -> DataFrame:
    """Enzyme-substrate edges: every pair of the two ids' accessions; unknown or
    unreviewed accessions are null."""
    label = F.replace(F.lower(F.col("modification_type")), F.lit(" "), F.lit("-"))
    rows = modifications.withColumn("label", label)
    if drop_nulls:
        rows = rows.where("enzyme_hprd_id is not null and substrate_hprd_id is not null and label is not null")
    ids = xrefs.select("hprd_id", F.explode_outer("swissprot_id").alias("acc"))
    side = lambda n: ids.select(F.col("hprd_id").alias(f"{n}_id"), F.col("acc").alias(n))
    rows = rows.join(side("source"), F.col("enzyme_hprd_id") == F.col("source_id"), "left").join(side("target"), F.col("substrate_hprd_id") == F.col("target_id"), "left")
    refs = F.array_distinct("reference_id")
    rows = rows.select("source", "target", "label", T.join_or_null(refs).alias("pubmed"), F.when(F.size(refs) > 1, F.array_join(F.array_repeat(F.lit("None"), F.size(refs)), ",")).alias("experiment_type"), ORDER)
    rows = null_unless_reviewed(null_unless_reviewed(rows, "source", proteins), "target", proteins)
    exclude = [x[:1].upper() + x[1:].lower() for x in exclude_labels] if exclude_labels else None
    return process(edge_frame(rows, pubmed="pubmed", experiment_type="experiment_type"), drop_nulls, allow_self_edges, allow_duplicates, exclude, min_counts, merge)


def pathway_edges(entries: DataFrame, relations: DataFrame, names: DataFrame, org: str | None = "hsa") -> DataFrame:
    """Edges of pathways: entries(pathway, id, name, type), relations(pathway, entry1, entry2, name, link).

    Entries name several genes; every pair of two entries' genes that names(old, new)
    knows is an edge. org None keeps genes of all organisms.
    """
    good = entries.where(F.col("type").isin(*ENTRY_TYPES)).select("pathway", "id", F.explode(F.split("name", " ")).alias("gene"))
    if org is not None:
        good = good.where(F.col("gene").contains(org) | F.col("gene").contains("ec"))
    good = good.join(names.select(F.col("old").alias("gene")), "gene", "left_semi")
    side = lambda e, n: good.select(F.col("pathway").alias(f"p_{n}"), F.col("id").alias(e), F.col("gene").alias(n))
    rows = relations.where(F.col("link").isin(*LINKS))
    for e, n in (("entry1", "source"), ("entry2", "target")):
        s = side(f"{e}_", n)
        rows = rows.join(s, (F.col("pathway") == F.col(f"p_{n}")) & (F.col(e) == F.col(f"{e}_"))).drop(f"p_{n}", f"{e}_")
    return edge_frame(rows.select("source", "target", F.replace("name", F.lit(" "), F.lit("-")).alias("label")))


def pathway_network(parts: list[DataFrame], names: DataFrame | None = None, proteins: DataFrame | None = None, unreviewed: bool = False, drop_nulls=False, allow_self_edges: bool = False, allow_duplicates: bool = False, min_counts: int | None = None, merge: bool = False) -> DataFrame:
    """All pathways together, mapped to proteins where names and proteins are given."""
    df = concat(parts)
    if names is not None and proteins is not None:
        df = map_edges(df, preferred(names, proteins, unreviewed))
    return process(df, drop_nulls, allow_self_edges, allow_duplicates, PATHWAY_EXCLUDED, min_counts, merge)
