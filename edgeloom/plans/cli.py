"""Command line: python -m edgeloom.plans.cli build|predict|validate|induce ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..ml import models
from ..operators import network, store
from ..sources import curated, edgelists, files, ontologies, proteins
from . import build, predict, validate
from .ship import ship


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="edgeloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "predict", "validate", "induce"):
        s = sub.add_parser(name)
        s.add_argument("--store", required=name != "induce")
        s.add_argument("--output")
        if name in ("build", "predict"):
            s.add_argument("--data", required=True, help="folder of source files")
        if name in ("predict", "validate", "build"):
            s.add_argument("--model")
        if name == "predict":
            s.add_argument("--input", required=True, help="edge list")
            s.add_argument("--map", help="saved map from old to current accessions")
        if name in ("build", "validate"):
            s.add_argument("--search", type=int, default=60 if name == "build" else 30, help="draws of each label's parameter search")
        if name == "validate":
            s.add_argument("--iterations", type=int, default=3)
            s.add_argument("--splits", type=int, default=5)
        if name == "induce":
            s.add_argument("--predictions", required=True)
            s.add_argument("--store-path", dest="store")
            one = s.add_mutually_exclusive_group(required=True)
            one.add_argument("--label")
            one.add_argument("--pathway", help="comma-separated accessions or gene names")
            s.add_argument("--genes", action="store_true")
            s.add_argument("--threshold", type=float, default=0.5)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("edgeloom").getOrCreate()
    ship(spark)
    at = lambda name: files.source_path(args.data, name)
    if args.command == "build":
        people = proteins.read_proteins(spark, at("sprot"), taxon_id=9606)
        terms, edges, alt = ontologies.read_gene_ontology(spark, at("gene_ontology"))
        methods, _ = ontologies.read_vocabulary(spark, at("methods"))
        pathways = edgelists.load_network(spark, f"{args.data}/networks/pathways.tsv")
        mods = curated.modification_network(curated.read_modifications(spark, at("modifications")), curated.read_xrefs(spark, at("xrefs")), people, allow_self_edges=True)
        nets = [edgelists.read_network(spark, at(n), r, allow_self_edges=True) for n, r in (("bioplex", "bioplex"), ("pina_sif", "sif"), ("pina_mitab", "pina_mitab"), ("innate_curated", "innate_mitab"), ("innate_imported", "innate_mitab"))]
        s = build.fill(spark, args.store, people, methods, build.split_networks(pathways, mods, nets), terms, edges, alt)
        build.train_default(s, args.model or f"{args.store}/model", n_iter=args.search)
    elif args.command == "predict":
        s = store.Store(spark, args.store)
        fitted = models.load(spark, args.model or f"{args.store}/model")
        names = files.read_saved_map(spark, args.map) if args.map else None
        found, invalid, changed, _ = predict.classify(edgelists.edge_list(spark, args.input), s, fitted, ontologies.read_gene_ontology(spark, at("gene_ontology")), names=names)
        predict.write_reports(found, invalid, store.labelled_network(s.read("interaction")), fitted.selection, vars(args), args.output, changed)
    elif args.command == "validate":
        train, held, labels = build.validation_sets(store.Store(spark, args.store))
        chosen: list = []
        scores = validate.bootstraps(train, labels, n_iter=args.iterations, n_splits=args.splits, search=args.search, holdout=held, chosen=chosen)
        validate.write_reports(train, held, labels, scores, chosen, args.output)
    else:
        rows = spark.read.csv(args.predictions, sep="\t", header=True, inferSchema=True)
        kept = network.by_label(rows, args.label, args.threshold) if args.label else network.by_pathway(rows, args.pathway.split(","), args.threshold, args.genes)
        known = store.labelled_network(store.Store(spark, args.store).read("interaction")) if args.store else rows.limit(0).selectExpr("'' source", "'' target", "'' label")
        nodes, table = network.induce(kept, known, args.label)
        files.write_report(nodes, f"{args.output}/nodes")
        files.write_report(table, f"{args.output}/edges")


if __name__ == "__main__":
    main()
