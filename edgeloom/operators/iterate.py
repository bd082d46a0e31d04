"""Helpers for loops over DataFrames: shared scratch space and scalable ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Our own where it is unset, but only in local mode: on a cluster a local folder is
    a different disk on each machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df into the shared folder and go on from there; lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Remove the files that cut wrote for df, which nothing reads any more."""
    spark = df.sparkSession
    path = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if path.isDefined():
        old = spark._jvm.org.apache.hadoop.fs.Path(path.get())
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def rank_within(df: DataFrame, keys: list[str], tie: list[str], alias: str, buckets: int = 64, seed: int = 0) -> DataFrame:
    """0-based place of each row among the rows of its keys, in a seeded order.

    A key's rows are dealt over buckets whose sizes are summed first, so that a key
    with a third of all rows is ranked in `buckets` tasks.
    """
    b = F.pmod(F.xxhash64(F.lit(seed), *tie), F.lit(buckets))
    dealt = df.withColumn("_bucket", b)
    cells = dealt.groupBy(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_cb")).agg(F.count("*").alias("_n"))
    names = [f"_c{i}" for i in range(len(keys))]
    before = Window.partitionBy(*names).orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    row = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(F.xxhash64(F.lit(seed + 1), *tie), *tie)) - 1
    match = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)] + [F.col("_bucket") == F.col("_cb")]
    out = dealt.withColumn("_row", row).join(cells, match)
    return out.withColumn(alias, F.col("_before") + F.col("_row")).select(*df.columns, alias)
