"""Build the store: mine networks, split training and holdout, annotate, train."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..ml import models
from ..operators import edges as E
from ..operators import mapping, ontology, store
from ..operators.features import ASPECTS, BAGS, pair_features
from ..operators.iterate import cut

#: Labels of the modification source that are kept for testing, and the
#: features a model reads.
TEST_LABELS = ["Phosphorylation", "Dephosphorylation"]
SELECTION = [*BAGS[:5], *[f"ulca_{a}" for a in ASPECTS]]


def split_networks(pathways: DataFrame, modifications: DataFrame, interactomes: list[DataFrame], min_counts: int = 5) -> dict[str, DataFrame]:
    """training, testing, common, full and interactome networks, each processed and merged.

    Modification edges with a test label are test candidates; edges that are also
    training edges form the common network. Self edges (homodimers) stay.
    """
    candidates = modifications.where(F.col("label").isin(*TEST_LABELS))
    rest = modifications.where(~F.coalesce(F.col("label").isin(*TEST_LABELS), F.lit(False)))
    training, testing, common = E.remove_common(E.concat([pathways, rest]), candidates)
    merge = lambda df, k=min_counts: E.process(df, allow_self_edges=True, min_counts=k, merge=True)
    return {
        "training": merge(training),
        "testing": merge(testing),
        "common": merge(common, None),
        "full": merge(E.concat([training, testing, common])),
        "interactome": E.process(E.concat(interactomes), drop_nulls=["source", "target"], allow_self_edges=True, merge=True),
    }


def annotate(pairs: DataFrame, proteins: DataFrame, terms: DataFrame, edges: DataFrame, alt_ids: DataFrame) -> DataFrame:
    """Feature columns for each pair."""
    paths = ontology.closure(edges)
    return pair_features(pairs, proteins, terms, paths, cut(ontology.depths(terms, paths)), alt_ids)


def fill(spark: SparkSession, path: str, proteins: DataFrame, psimi: DataFrame, networks: dict[str, DataFrame], terms: DataFrame, edges: DataFrame, alt_ids: DataFrame, taxon_id: int = 9606) -> store.Store:
    """Write all five tables."""
    s = store.Store(spark, path)
    s.create()
    s.write("protein", store.upsert(s.read("protein"), proteins, "uniprot_id").drop("change"))
    s.write("psimi", store.upsert(s.read("psimi"), psimi.select(F.col("id").alias("accession"), F.col("name").alias("description")), "accession").drop("change"))
    flat = cut(store.merge_flags(networks["training"], networks["testing"], networks["common"], networks["interactome"]))
    found = annotate(flat, s.read("protein"), terms, edges, alt_ids)
    s.write("interaction", flat.join(found, ["source", "target"], "left").withColumn("taxon_id", F.lit(taxon_id)))
    links = cut(store.reference_links(flat))
    s.write("pubmed", links.select(F.col("pubmed").alias("accession")).distinct())
    s.write("reference", links)
    return s


def learning_table(interactions: DataFrame, labels: list[str], selection: list[str] = SELECTION) -> DataFrame:
    """source, target, text and y_<label> columns."""
    own = T.split_cell(F.col("label"))
    return interactions.select("source", "target", T.feature_text(*[F.col(c) for c in selection]).alias("text"), F.array_intersect(own, F.lit(labels)).alias("labels"), *[F.array_contains(own, x).cast("int").alias(f"y_{x}") for x in labels])


def labels_of(interactions: DataFrame) -> list[str]:
    """Sorted labels of the labelled network; a vocabulary, so it fits the driver."""
    from ..operators.reports import label_vocabulary

    return [r[0] for r in label_vocabulary(store.labelled_network(interactions)).collect()]


def training_set(s: store.Store, selection: list[str] = SELECTION) -> tuple[DataFrame, list[str]]:
    rows = store.labelled_network(s.read("interaction"))
    labels = labels_of(rows)
    return learning_table(rows, labels, selection), labels


def validation_sets(s: store.Store, selection: list[str] = SELECTION) -> tuple[DataFrame, DataFrame, list[str]]:
    """Strict training rows and their labels, strict holdout rows."""
    rows = s.read("interaction")
    labels = labels_of(store.training(rows, strict=True))
    return learning_table(store.training(rows, strict=True), labels, selection), learning_table(store.holdout(rows, strict=True), labels, selection), labels


def interactome_set(s: store.Store, selection: list[str] = SELECTION) -> DataFrame:
    return learning_table(store.interactome(s.read("interaction")), [], selection)


def train_default(s: store.Store, path: str, selection: list[str] = SELECTION, n_iter: int = 60, splits: int = 3, seed: int = 42) -> models.Classifier:
    """Search the published ensemble's parameters on the labelled network, fit and save it.

    n_iter 0 fits default parameters.
    """
    rows, labels = training_set(s, selection)
    if n_iter:
        fitted, _ = models.searched(rows.withColumn("edge", F.concat_ws("|", "source", "target")), labels, selection, n_iter=n_iter, splits=splits, seed=seed)
    else:
        fitted = models.train(rows, labels, selection)
    fitted.save(path)
    return fitted


def remap(networks: list[DataFrame], names: DataFrame, proteins: DataFrame) -> list[DataFrame]:
    """Networks through the accession map, restricted to known proteins."""
    wanted = reduce(DataFrame.unionByName, [n.select(F.explode(F.array("source", "target")).alias("old")) for n in networks]).distinct()
    lists = mapping.batch_map(wanted, names, proteins).select("old", F.explode("new").alias("new"))
    return [mapping.map_edges(n, lists) for n in networks]
