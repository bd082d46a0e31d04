import pytest
from pyspark.sql import functions as F

from edgeloom.ml import folds, metrics, models
from edgeloom.operators import network, reports


def test_allot_is_complete_and_even():
    counts = {("a",): 10, ("b",): 4, ("a", "b"): 5, (): 11}
    dealt = folds.allot(counts, 3, seed=1)
    assert {k: sum(v) for k, v in dealt.items()} == counts
    for label in "ab":
        per = [sum(v[k] for s, v in dealt.items() if label in s) for k in range(3)]
        assert max(per) - min(per) <= 1
    assert max(dealt[()]) - min(dealt[()]) <= 2
    with pytest.raises(ValueError):
        folds.allot({("a",): 1}, 3)


def test_folds_partition_rows(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 3 == 0, F.array(F.lit("a"))).when(F.col("id") % 3 == 1, F.array(F.lit("b"), F.lit("a"))).alias("labels"))
    out = folds.stratified_folds(df, "labels", "id", 4, seed=2)
    assert out.select("id").distinct().count() == 200 == out.count()
    sizes = [r[0] for r in out.groupBy("fold").count().select("count").collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 3


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "y_a int, p_a int")
    got = {r.metric: r.value for r in metrics.score_labels(df, ["a"]).collect()}
    assert got == {"f1": 0.5, "precision": 0.5, "recall": 0.5, "specificity": pytest.approx(2 / 3), "fdr": 0.5}
    rows = spark.createDataFrame([([1, 0], [0, 0], [0.2, 0.4]), ([0, 0], [1, 0], [0.2, 0.4]), ([1, 1], [1, 0], [0.9, 0.4])], "y array<int>, p array<int>, s array<double>")
    y, p = F.col("y"), F.col("p")
    out = rows.agg(metrics.positive_hamming(y, p), metrics.hamming(y, p), metrics.samples_f1(y, p), metrics.ranking_loss(y, F.col("s"))).first()
    assert [round(x, 6) for x in out] == [0.5, 0.5, round((2 / 3) / 3, 6), round(1 / 3, 6)]


@pytest.fixture(scope="module")
def learning(spark):
    rows = [(k, "GO1 GO2" if k % 2 else "GO3 GO4", k % 2, int(k % 4 == 0)) for k in range(80)]
    return spark.createDataFrame(rows, "id int, text string, y_a int, y_b int")


def test_relevance_and_saving(spark, learning, tmp_path):
    fitted = models.train(learning, ["a", "b"], ["go"], make=lambda labels: models.BinaryRelevance({x: models.make_classifier("LogisticRegression", regParam=0.01) for x in labels}))
    out = fitted.predict_proba(learning)
    assert out.where("(y_a = 1) = (`a-pr` >= 0.5)").count() == 80
    fitted.save(str(tmp_path / "m"))
    again = models.load(spark, str(tmp_path / "m")).predict_proba(learning)
    assert again.agg(F.sum("`a-pr`")).first()[0] == pytest.approx(out.agg(F.sum("`a-pr`")).first()[0])


def test_chains_neighbours_and_search(spark, learning, tmp_path):
    from pyspark.ml import Pipeline

    rows = Pipeline(stages=models.vectorizer("text")).fit(learning).transform(learning)
    chains = models.RandomChains("MultinomialNB", ["a", "b"], k=2, seed=1).fit(rows)
    assert chains.predict(rows).where("p_a = y_a").count() == 80
    near = models.Neighbours(3).fit(rows.withColumn("label", F.col("y_a")))
    assert models.positive(near.transform(rows), "p").where("(p >= 0.5) = (y_a = 1)").count() == 80
    near.save(str(tmp_path / "near"))
    again = models.NeighboursModel.load(str(tmp_path / "near"))
    assert again.k == 3 and models.positive(again.transform(rows), "p").where("(p >= 0.5) = (y_a = 1)").count() == 80
    found, picks = models.searched(learning.withColumn("labels", F.array_compact(F.array(F.when(F.col("y_a") == 1, "a"), F.when(F.col("y_b") == 1, "b")))), ["a"], [], id_col="id", algorithms={"a": "KNeighborsClassifier"}, n_iter=1, splits=2)
    assert picks[0][1] == 1.0 and found.predict_proba(learning).where("(y_a = 1) = (`a-pr` >= 0.5)").count() == 80
    search = folds.single_label_folds(rows.withColumn("label", F.col("y_a").cast("double")), "label", "id", 2)
    assert models.random_search(search, "BernoulliNB", folds=2, n_iter=2)[1] == 1.0
    with pytest.raises(ValueError):
        models.make_classifier("Nothing")


def test_reports(spark):
    df = spark.createDataFrame([(0.6, 0.2), (0.6, 0.6), (0.1, 0.1)], "`A-pr` double, `B-pr` double")
    out = reports.summarise_probabilities(df, ["A", "B"]).orderBy(F.col("`sum-pr`").desc()).collect()
    assert [(r["classification"], r["classification_at_max"]) for r in out] == [("A,B", "A"), ("A", "A"), (None, "A")]
    curve = {round(r.threshold, 2): r.share for r in reports.threshold_curve(reports.summarise_probabilities(df, ["A", "B"]), "`max-pr`").collect()}
    assert len(curve) == 21 and curve[0.0] == 1.0 and curve[0.6] == pytest.approx(2 / 3) and curve[1.0] == 0.0
    rho = {(r.a, r.b): r.rho for r in reports.spearman(spark.createDataFrame([(1, 1, 0), (0, 0, 0), (1, 0, 0)], "u int, v int, w int"), ["u", "v", "w"]).collect()}
    assert rho["u", "u"] == pytest.approx(1.0) and rho["u", "v"] == pytest.approx(0.5) and rho["u", "w"] is None


def test_network(spark):
    p = spark.createDataFrame([("A", "B", "GA", "GB", 0.9, 0.9), ("B", "C", "GB", "GC", 0.2, 0.2)], "protein_a string, protein_b string, gene_a string, gene_b string, `max-pr` double, `X-pr` double")
    known = spark.createDataFrame([("A", "B", "X,Y")], "source string, target string, label string")
    nodes, edges = network.induce(network.by_label(p, "X", 0.5), known, "X")
    assert [tuple(r) for r in nodes.collect()] == [("A", "GA", True), ("B", "GB", True)]
    assert [(r.name, r.edge_in_training) for r in edges.collect()] == [("A pp B", True)]
    assert network.by_pathway(p, ["GC"], 0.1, genes=True).count() == 1
    with pytest.raises(ValueError):
        network.by_pathway(p, ["C"], 0.5)
    with pytest.raises(ValueError):
        network.by_label(p, "Z", 0.5)


@pytest.mark.parametrize(("block", "meetings"), [(1000, 1_000_000), (7, 20)])
def test_neighbours_are_brute_force(spark, monkeypatch, block, meetings):
    """The votes of the k nearest of all rows, repeated ones as often as they occur; ids divisible by 50 ask."""
    import random

    from pyspark.ml.linalg import Vectors

    monkeypatch.setattr(models, "BLOCK", block)
    monkeypatch.setattr(models, "MEETINGS", meetings)
    rnd, k = random.Random(4), 3
    vectors = [{j: rnd.randint(0, 3) for j in rnd.sample(range(30), rnd.randint(0, 6))} for _ in range(70)]
    vectors += vectors[:10]
    data = [(n, Vectors.sparse(30, v), float(rnd.randint(0, 1))) for n, v in enumerate(vectors)]
    rows = spark.createDataFrame(data, ["id", "features", "label"]).repartition(3)
    got = {r.id: r.p for r in models.positive(models.Neighbours(k).fit(rows).transform(rows.where("id % 2 = 0").select("id", "features")), "p").collect()}
    hashed = {r.id: r.h for r in rows.select("id", F.xxhash64("features", "label").alias("h")).collect()}
    assert sorted(got) == list(range(0, 80, 2))
    for n in got:
        far = sorted((data[n][1].squared_distance(x), hashed[m], y) for m, x, y in data)[:k]
        assert got[n] == pytest.approx(sum(y for _, _, y in far) / k)


def test_registered_search_asks_ids_divisible_by_50(spark, tmp_path):
    from edgeloom import contract

    spark.createDataFrame([(k, f"a{k % 4} b{k % 3} c") for k in range(101)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(101)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(r.doc_id for r in contract.nearest_neighbours(spark, f"file://{tmp_path}").collect()) == [0, 50, 100]


def test_chained_vectors_name_no_terms(spark, learning):
    """Earlier labels stand behind the features, as VectorAssembler puts them, without a name per term."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    rows = Pipeline(stages=models.vectorizer("text")).fit(learning).transform(learning)
    want = VectorAssembler(inputCols=["features", "y_a", "y_b"], outputCol="want").transform(rows)
    out = want.select("want", models._behind("features", ["y_a", "y_b"]).alias("got"))
    assert all(r.got.size == r.want.size and (r.got.toArray() == r.want.toArray()).all() for r in out.collect())
    assert "attrs" not in str(out.schema["got"].metadata) and "attrs" in str(out.schema["want"].metadata)
