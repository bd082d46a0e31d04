from edgeloom.operators.store import Store
from edgeloom.streaming import edges as S

SCHEMA = "source string, target string, label string, pubmed string, experiment_type string"


def test_stream_of_edges(spark, tmp_path):
    spark.createDataFrame([("b", "a", "x y"), ("a", "a", "x"), (None, "a", "x"), ("c", "d", "x y,z")], "source string, target string, label string").selectExpr("*", "cast(null as string) pubmed", "cast(null as string) experiment_type").write.parquet(str(tmp_path / "in"))
    clean = S.clean(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    q = S.label_counts(clean).writeStream.outputMode("complete").format("memory").queryName("label_counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.label: r.n for r in spark.table("label_counts").collect()} == {"X-y": 2, "Z": 1}


def test_micro_batches_fold_into_the_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    run = S.fold_into(s, "psimi", "accession")
    batch = spark.createDataFrame([("MI:1", "one")], "accession string, description string")
    run(batch, 0)
    run(batch, 0)
    assert s.read("psimi").count() == 1
