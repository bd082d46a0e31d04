"""Connected components of an edge list, in one task or by alternating large and small stars.

Up to ONE edges are one task's work: a round of stars costs up to eight shuffles, whose files,
and the events of whose tasks, take far more disk than a short list of edges. Beyond that, each
round replaces edges by edges to the smallest neighbour; the number of rounds
grows with the logarithm of the longest path. Nothing but two numbers a round
reaches the driver. A node's least neighbour is an aggregate that combines before its
shuffle and is written as a table of its own, so that Spark can split the join of a hub
with its neighbours.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges up to which one task finds the components, in about 200 MB.
ONE = 1_000_000


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges, ascending, and the least node reachable from each."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):  # all of root are roots of themselves or point to one
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        held = [batch for batch in batches if batch.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            found = least_reachable(*(table.column(k).to_numpy() for k in (0, 1)))
            columns = [pa.array(x, table.schema.field(0).type) for x in found]
            yield from pa.Table.from_arrays(columns, ["node", "component"]).to_batches(max_chunksize=100_000)

    kind = edges.schema["u"].dataType.simpleString()
    return cut(edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame) -> DataFrame:
    """Each u's neighbours v, with m = the least of u and all v."""
    least = cut(pairs.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")))
    return pairs.join(least, F.col("u") == F.col("c")).select("u", "v", F.least("m", "u").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) for every node of edges(u, v); no loops or nulls in it."""
    edges = cut(edges.select("u", "v").where("u <> v"))
    if edges.count() <= ONE:
        return _in_one_task(edges)
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        large = _star(_both(edges)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
