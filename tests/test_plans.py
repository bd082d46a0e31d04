import pytest
from pyspark.sql import functions as F

from edgeloom.ml import models
from edgeloom.operators import store
from edgeloom.plans import build, cli, predict, validate

FRAME = "source string, target string, label string, pubmed string, experiment_type string, _ord long"
PROTEIN = "uniprot_id string, taxon_id int, gene_id string, go_mf string, go_cc string, go_bp string, interpro string, pfam string, keywords string, function string, reviewed boolean"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Twelve proteins of two families, whose edges within a family are activations."""
    people = spark.createDataFrame([(f"P{k:02d}", 9606, f"G{k}", "GO:3" if k % 2 else "GO:2", None, None, f"IPR{k % 2}", f"PF{k % 3}", None, None, True) for k in range(12)] + [("M1", 10090, *[None] * 8, True)], PROTEIN)
    terms = spark.createDataFrame([("GO:1", "root", "molecular_function", False), ("GO:2", "a", "molecular_function", False), ("GO:3", "b", "molecular_function", False)], "id string, name string, namespace string, is_obsolete boolean")
    edges = spark.createDataFrame([("GO:2", "GO:1", "is_a"), ("GO:3", "GO:1", "is_a")], "child string, parent string, rel string")
    alt = spark.createDataFrame([], "alt string, id string")
    pairs = [(f"P{a:02d}", f"P{b:02d}") for a in range(12) for b in range(a + 1, 12)]
    label = lambda a, b: "Activation" if int(a[1:]) % 2 == int(b[1:]) % 2 else "Phosphorylation"
    frame = lambda rows: spark.createDataFrame([(a, b, lab, str(k), "MI:1", k) for k, (a, b, lab) in enumerate(rows)], FRAME)
    pathways = frame([(a, b, label(a, b)) for a, b in pairs[:40]])
    mods = frame([(a, b, "Phosphorylation") for a, b in pairs[38:50]])
    other = frame([(a, b, None) for a, b in pairs[45:60]])
    nets = build.split_networks(pathways, mods, [other], min_counts=2)
    path = f"file://{tmp_path_factory.mktemp('world')}"
    methods = spark.createDataFrame([("MI:1", "two hybrid")], "id string, name string")
    s = build.fill(spark, f"{path}/store", people, methods, nets, terms, edges, alt)
    return s, path, (terms, edges, alt), pairs


def test_store_holds_everything(world):
    s, _, _, _ = world
    rows = s.read("interaction")
    assert store.training(rows).count() >= 38 and store.holdout(rows, strict=True).count() >= 1 and store.interactome(rows).count() == 15
    assert rows.where("interpro is null").count() == 0 and rows.where("ulca_go_mf is null").count() == 0
    assert s.read("reference").select("pubmed").distinct().count() == s.read("pubmed").count()


def test_train_classify_and_report(spark, world, tmp_path):
    s, path, tables, pairs = world
    rows, labels = build.training_set(s)
    assert labels == ["Activation", "Phosphorylation"]
    make = lambda names: models.BinaryRelevance({x: models.make_classifier("LogisticRegression", regParam=0.01) for x in names})
    models.train(rows, labels, build.SELECTION, make).save(f"{path}/model")
    fitted = models.load(spark, f"{path}/model")
    asked = spark.createDataFrame([*pairs[:3], *pairs[-3:], ("P00", "M1"), ("P00", None)], "source string, target string")
    names = spark.createDataFrame([("OLD", pairs[0][0])], "old string, new string")
    renamed = asked.withColumn("source", F.when((F.col("source") == pairs[0][0]) & (F.col("target") == pairs[0][1]), "OLD").otherwise(F.col("source")))
    found, invalid, changed, order = predict.classify(renamed, s, fitted, tables, names=names)
    assert [tuple(r) for r in changed.collect()] == [("OLD", pairs[0][0])] and order == labels
    got = {(r.source, r.target): r for r in found.collect()}
    assert len(got) == 6 and invalid.count() == 2
    assert got["P09", "P11"]["Activation-pr"] > got["P10", "P11"]["Activation-pr"]
    predict.write_reports(found, invalid, store.labelled_network(s.read("interaction")), fitted.selection, {"a": 1}, str(tmp_path), changed)
    assert spark.read.json(f"{tmp_path}/accession_map.json").first().new == [pairs[0][0]]
    assert spark.read.csv(f"{tmp_path}/predictions.tsv", sep="\t", header=True).count() == 6
    table = predict.prediction_table(found, s.read("protein"))
    assert {"protein_a", "gene_a", "gene_b"} <= set(table.columns)
    table.drop("labels", "text").write.csv(f"{tmp_path}/table", sep="\t", header=True)
    cli.main(["induce", "--predictions", f"{tmp_path}/table", "--label", "Activation", "--threshold", "0.1", "--output", f"{tmp_path}/net"])
    assert spark.read.csv(f"{tmp_path}/net/edges", sep="\t", header=True).count() >= 1
    with pytest.raises(ValueError):
        predict.classify(asked, s, models.Classifier(fitted.vectors, fitted.relevance, ["nothing"]), tables)


def test_validation(world):
    s, _, _, _ = world
    train, held, labels = build.validation_sets(s)
    make = lambda: models.BinaryRelevance({x: models.make_classifier("MultinomialNB") for x in labels})
    binary, multi = validate.summary(validate.bootstraps(train, labels, make, n_iter=2, n_splits=2))
    assert binary.count() == len(labels) * 5 and {r.metric for r in multi.collect()} == {"f1", "precision", "recall", "specificity", "fdr"}
    parts = validate.similarities(train, held, labels)
    assert parts["train"].where("label_a = label_b").agg(F.min("jaccard")).first()[0] == 1.0


def test_search_validates_and_reports(spark, world, tmp_path):
    """Parameters are searched inside the folds; every report file is written."""
    s, path, _, _ = world
    train, held, labels = build.validation_sets(s)
    chosen: list = []
    scores = validate.bootstraps(train, labels, n_iter=1, n_splits=2, search=1, holdout=held, chosen=chosen)
    assert len(chosen) == 2 * len(labels) and all(0 <= c[3] <= 1 and "featuresCol" in c[4] for c in chosen)
    validate.write_reports(train, held, labels, scores, chosen, str(tmp_path))
    assert {r.label for r in spark.read.csv(f"{tmp_path}/label_order.csv", header=True).collect()} == set(labels)
    rows = spark.read.csv(f"{tmp_path}/results_f1_ml.tsv", sep="\t", header=True)
    assert set(labels) <= {r.label for r in rows.collect()}
    assert spark.read.text(f"{tmp_path}/stability.txt").count() == len(chosen)
    assert {r.condition for r in spark.read.csv(f"{tmp_path}/binary_stats.csv", header=True).collect()} == {"validation", "holdout"}
    assert spark.read.json(f"{tmp_path}/training_distribution.json").where("label = 'n_samples'").first().n == train.count()


def test_command_line_needs_one_choice():
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["induce", "--predictions", "x"])


def test_self_edges_stay(spark):
    frame = lambda rows: spark.createDataFrame([(a, b, lab, str(k), "MI:1", k) for k, (a, b, lab) in enumerate(rows)], FRAME)
    nets = build.split_networks(frame([("A", "A", "Activation"), ("A", "B", "Activation"), ("C", "C", "Activation")]), frame([("D", "D", "Phosphorylation"), ("C", "C", "Phosphorylation")]), [frame([("E", "E", None)])], min_counts=1)
    own = {k: sorted(r.source for r in v.where("source = target").collect()) for k, v in nets.items()}
    assert own == {"training": ["A"], "testing": ["D"], "common": ["C"], "full": ["A", "C", "D"], "interactome": ["E"]}
