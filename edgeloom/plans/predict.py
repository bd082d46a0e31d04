"""Classify interactions and report on the predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..ml.models import Classifier
from ..operators import features, mapping, reports, store
from ..operators.iterate import cut
from ..sources import files
from .build import annotate, learning_table


def classify(pairs: DataFrame, s: store.Store, classifier: Classifier, ontology_tables: tuple[DataFrame, DataFrame, DataFrame], taxon_id: int = 9606, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(predictions, invalid, mapping, labels): pairs in the store are reused, new ones get features.

    names(old, new): pairs are first mapped to current accessions; mapping(old, new) says
    which of the input's accessions changed. labels is the order of the probabilities.
    """
    unknown = set(classifier.selection) - set(store.SCHEMAS["interaction"].replace(",", "").split())
    if unknown:
        raise ValueError(f"unknown features: {', '.join(sorted(unknown))}")
    asked = pairs.select(F.explode(F.array("source", "target")).alias("old")).where("old is not null").distinct()
    if names is None:
        mapping_ = asked.select("old", F.col("old").alias("new")).limit(0)
    else:
        mapping_ = cut(asked.join(names, "old").groupBy("old").agg(F.max("new").alias("new")).where("old <> new"))
        for end in ("source", "target"):
            pairs = pairs.join(mapping_.select(F.col("old").alias("m_old"), F.col("new").alias("m_new")), F.col(end) == F.col("m_old"), "left").withColumn(end, F.coalesce("m_new", end)).drop("m_old", "m_new")
    existing, missing, invalid = store.resolve(pairs, s.read("protein"), s.read("interaction"), taxon_id)
    made = annotate(missing, s.read("protein"), *ontology_tables).withColumns({"taxon_id": F.lit(taxon_id), "label": F.lit(None).cast("string"), **{f"is_{x}": F.lit(False) for x in ("training", "holdout", "interactome")}})
    rows = existing.unionByName(made, allowMissingColumns=True)
    labels = list(classifier.relevance.models)
    out = classifier.predict_proba(learning_table(rows, labels, classifier.selection))
    flags = rows.select("source", "target", (F.col("is_training") | F.col("is_holdout")).alias("seen"), *classifier.selection)
    return reports.summarise_probabilities(out.join(flags, ["source", "target"]), labels), invalid, mapping_, labels


def prediction_table(predicted: DataFrame, proteins: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """protein_a, protein_b, genes and, with a map of input names, input_a and input_b."""
    out = predicted.withColumnsRenamed({"source": "protein_a", "target": "protein_b"})
    for side in "ab":
        out = mapping.enrich(out, f"protein_{side}", proteins, "uniprot_id", "gene_id", f"gene_{side}")
        if names is not None:
            out = mapping.enrich(out, f"protein_{side}", mapping.reverse_last(names.withColumn("_ord", F.col("old"))), "new", "old", f"input_{side}")
    return out


def write_reports(predicted: DataFrame, invalid: DataFrame, training: DataFrame, selection: list[str], settings: dict, path: str, accessions: DataFrame | None = None) -> None:
    """All prediction reports below path; accessions(old, new) is the map of changed inputs."""
    spark = predicted.sparkSession
    terms = lambda df: F.array_distinct(F.flatten(F.array(*[T.split_cell(F.col(c)) for c in selection])))
    vocabulary = training.select(F.explode(terms(training)).alias("term")).distinct()
    keyed = predicted.withColumn("edge", F.concat_ws("|", *[c for c in ("source", "target", "protein_a", "protein_b") if c in predicted.columns]))
    use = features.usability(keyed.withColumn("terms", terms(keyed)), "edge", "terms", vocabulary)
    table = keyed.join(use, "edge").drop("edge", "labels", "text")
    files.write_settings(spark, settings, f"{path}/settings.json")
    files.write_report(invalid, f"{path}/invalid.tsv")
    if accessions is not None:
        files.write_map(accessions, f"{path}/accession_map.json")
    files.write_report(reports.class_distribution(training), f"{path}/training_distribution.json", "json")
    files.write_report(table, f"{path}/predictions.tsv")
    files.write_report(reports.threshold_curve(table, "`max-pr`"), f"{path}/thresholds.csv", "csv")
    files.write_report(reports.dataset_statistics(table, "seen", "`max-pr`", "usability"), f"{path}/dataset_statistics.json", "json")
    files.write_report(reports.class_distribution(table, "classification"), f"{path}/prediction_distribution.json", "json")
