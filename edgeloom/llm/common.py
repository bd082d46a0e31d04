"""Helpers shared by the training-data operators.

Every operator takes a DataFrame plus column names, selects only the columns it
needs (so extra or clashing columns never matter) and cuts lineage through the
cluster's shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.iterate import cut, shared_dir

__all__ = ["SPACE", "WORD", "cut", "documents", "let", "place_of", "ranked", "shared_dir", "whole_keys", "word_count"]

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """Bind value once and use it many times inside body.

    A lambda variable is evaluated once, whereas an expression repeated inside a
    lambda would be evaluated for every element.
    """
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    """Number of words; null counts none. JVM only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(values: DataFrame, column: str, place: str, parts: int = 8) -> DataFrame:
    """values, distinct in column, with their 0-based place in ascending order, null last.

    Ranges of values are sorted apart and their sizes added up, so no task needs all.
    """
    order = F.col(column).asc_nulls_last()
    ranged = cut(values.repartitionByRange(parts, order).withColumn("r_range", F.spark_partition_id()))
    sizes = ranged.groupBy("r_range").agg(F.count("*").alias("n"))  # `parts` rows at most
    before = F.coalesce(F.sum("n").over(Window.orderBy("r_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("r_range").orderBy(order)) - 1
    placed = ranged.withColumn("r_own", own).join(F.broadcast(sizes.select("r_range", before.alias("r_before"))), "r_range")
    return placed.withColumn(place, (F.col("r_before") + F.col("r_own")).cast("long")).drop("r_range", "r_own", "r_before")


def place_of(df: DataFrame, column: str, place: str, last: int) -> DataFrame:
    """df with a long that orders rows as column does; `last` for null.

    Whole numbers stand for themselves; values of other types are ranked.
    """
    if dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint"):
        return df.withColumn(place, F.coalesce(F.col(column).cast("long"), F.lit(last)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = cut(ranked(df.select(F.col(column).alias("p_value")).where("p_value is not null").distinct(), "p_value", "p_place", parts))
    found = df.join(values, F.col(column) == F.col("p_value"), "left")
    return found.withColumn(place, F.coalesce("p_place", F.lit(last))).drop("p_value", "p_place")


def whole_keys(batches, column: int, rows: int = 1):
    """Record batches regrouped so that equal keys, which follow each other, come together.

    A group ends with the first key that brings it to `rows` rows, so a task holds
    that much and one key at most. There are no null keys.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []
    n = 0

    def joined():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column)
        cuts = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False).nonzero()[0] + 1
        if held and held[-1].column(column)[-1] != key[0]:
            cuts = np.concatenate([[0], cuts])
        start = 0
        while True:
            k = int(np.searchsorted(cuts, start + max(rows - n, 0 if n else 1)))
            if k == len(cuts):
                break
            at = int(cuts[k])
            if at > start:
                held.append(batch.slice(start, at - start))
            yield joined()
            held, n, start = [], 0, at
        held.append(batch.slice(start))
        n += held[-1].num_rows
    if n:
        yield joined()
