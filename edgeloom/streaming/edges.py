"""Edges that arrive as a stream: the row-wise operators as they are, counts with state.

The batch operators of operators.edges that look at one row (edge_frame, remove_nulls,
remove_self_edges, remove_labels) work on streams unchanged. Deduplication and merging
over all time need unbounded state, so streams fold each micro-batch into the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.edges import edge_frame, remove_nulls, remove_self_edges


def clean(stream: DataFrame) -> DataFrame:
    """Canonical edges without nulls and self edges."""
    return remove_self_edges(remove_nulls(edge_frame(stream, pubmed="pubmed", experiment_type="experiment_type")))


def label_counts(stream: DataFrame, time: str | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per label, over all time or per window of an event time with a watermark."""
    rows = stream if time is None else stream.withWatermark(time, late)
    keys = [] if time is None else [F.window(time, window).alias("window")]
    each = rows.withColumn("label", F.explode(T.split_cell(F.col("label"))))
    return each.groupBy(*keys, "label").agg(F.count("*").alias("n"))


def fold_into(store, table: str, key: str):
    """A foreachBatch function that upserts each micro-batch; replaying a batch changes nothing."""
    from ..operators.store import upsert

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.write(table, upsert(store.read(table), batch.dropDuplicates([key]), key).drop("change"))

    return run
