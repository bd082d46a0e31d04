"""Small tables, maps, ARFF and report files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .edgelists import read_cells

#: Where each source lies, relative to a data folder; override by passing a path.
PATHS = {
    "sprot": "uniprot_sprot.dat.gz", "trembl": "uniprot_trembl.dat.gz", "modifications": "hprd/modifications.txt", "xrefs": "hprd/id_mappings.txt",
    "bioplex": "networks/bioplex.tsv", "innate_curated": "networks/innate_curated.mitab.gz", "innate_imported": "networks/innate_imported.mitab.gz", "pina_sif": "networks/pina.sif", "pina_mitab": "networks/pina.mitab",
    "gene_ontology": "go.obo.gz", "methods": "mi.obo.gz", "interpro": "interpro_names.tsv", "pfam": "pfam_names.tsv",
}


def source_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{PATHS[name]}"


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """id (first column, upper case), name (last column); later rows win."""
    df = read_cells(spark, path, header=False)
    cells = [c for c in df.columns if c.startswith("c")]
    last = F.element_at(F.array_compact(F.array(*cells)), -1)
    return df.groupBy(F.upper("c0").alias("id")).agg(F.max_by(last, "_ord").alias("name"))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """old, new from a JSON object of lists."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("old", "news")).select("old", F.explode("news").alias("new"))


def write_map(names: DataFrame, path: str) -> None:
    """One JSON object a line, {"old": ..., "new": [...]}: any number of accessions."""
    names.groupBy("old").agg(F.array_sort(F.collect_set("new")).alias("new")).write.mode("overwrite").json(path)


def read_saved_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("old string, new array<string>").json(path).select("old", F.explode("new").alias("new"))


def write_arff(df: DataFrame, path: str, labels: list[str], features: list[str], vocabulary: list[str], name: str = "interactions", unlabelled: bool = False, compression: str | None = None) -> None:
    """Label attributes first, then one count attribute per vocabulary term.

    The header is the first part file and the data follow in as many as they have
    partitions; read in the order of their names they are one ARFF file. Labels of
    unlabelled rows are `?`.
    """
    head = [f"@RELATION '{name}: -C {len(labels)}'", ""]
    head += [f"@ATTRIBUTE {x} {{0,1}}" for x in labels] + [f"@ATTRIBUTE {x} NUMERIC" for x in vocabulary] + ["", "@DATA"]
    text = T.feature_text(*[F.col(c) for c in features])
    found = F.regexp_extract_all(text, F.lit(r"\b\w\w+\b"), F.lit(0))
    own = T.split_cell(F.col("label"))
    flags = [F.lit("?") if unlabelled else F.array_contains(own, x).cast("int").cast("string") for x in labels]
    every = F.lit(vocabulary) if vocabulary else F.array().cast("array<string>")
    # each distinct token is counted once; a term takes its count from there
    times = F.transform(F.array_distinct(found), lambda w: F.struct(w.alias("w"), F.size(F.filter(found, lambda x: x == w)).cast("string").alias("n")))
    rows = df.select(*[x.alias(f"flag{k}") for k, x in enumerate(flags)], F.map_from_entries(times).alias("times"))
    counts = F.transform(every, lambda v: F.coalesce(F.try_element_at("times", v), F.lit("0")))
    body = rows.select(F.concat_ws(",", *[f"flag{k}" for k in range(len(flags))], F.array_join(counts, ",")).alias("value"))
    top = df.sparkSession.range(0, 1, 1, 1).select(F.lit("\n".join(head)).alias("value"))
    writer = top.unionByName(body).write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)


def write_report(df: DataFrame, path: str, kind: str = "tsv") -> None:
    """A report table as tsv, csv or json."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
    else:
        T.fill_nulls(df).write.mode("overwrite").csv(path, sep="\t" if kind == "tsv" else ",", header=True)


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    spark.range(1).select(F.lit(json.dumps(settings, sort_keys=True, default=str)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
