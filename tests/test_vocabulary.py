from edgeloom.ml import models


def test_vocabulary_has_no_limit(spark):
    from pyspark.ml import Pipeline

    docs = spark.range(270).selectExpr("concat_ws(' ', transform(sequence(id * 1000, id * 1000 + 999), x -> 'T' || x)) AS text")
    fitted = Pipeline(stages=models.vectorizer("text")).fit(docs)
    assert len(fitted.stages[1].vocabulary) == 270_000 > 1 << 18


def test_registered_vectors_hold_every_term(spark, tmp_path):
    from edgeloom import contract

    spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(100))) for k in range(8)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert contract.vectors(spark, f"file://{tmp_path}").first().features.size == 800
    assert contract.nearest_neighbours(spark, f"file://{tmp_path}").count() == 1  # queries are ids divisible by 50
