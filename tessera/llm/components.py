"""Connected components of a table of links, by alternating large and small stars.

Each round only groups by a node and takes a minimum, which combines before the
shuffle; the neighbours of a node are never gathered. Minima are written to the
checkpoint folder before they are joined back, so that both sides of the join
are plain exchanges and AQE can split the partition of a node with very many
links; small tables of minima, whose rows have been counted, are broadcast. Up
to a counted bound of links all of this is one task's work, with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Tables of at most this many (node, node) rows, 16 bytes each, are broadcast.
BROADCAST_ROWS = 50_000


#: At most this many links, 16 bytes each, are joined in one task.
ONE_TASK = 500_000


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links u-v, and the smallest node reachable from each."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        for x in (i, j, before[i], before[j]):
            np.minimum.at(label, x, low)
        label = label[label]
        if np.array_equal(label, before):
            return nodes, nodes[label]


def _in_one_task(batches):
    links = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if links:
        nodes, roots = smallest_reachable(*(np.concatenate(x) for x in zip(*links)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])


def bounded(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for a broadcast if its counted ``rows`` are at most ``most``."""
    return F.broadcast(df) if rows <= most else df


def _minima(pairs: DataFrame) -> tuple[DataFrame, int]:
    least = checkpoint(pairs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
    return least, least.count()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least, n = _minima(both)
    return both.where("v > u").join(bounded(least, n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least, n = _minima(down)
    joined = down.join(bounded(least, n), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that a link of ``edges`` (u, v: long) touches; root is the component's smallest node.

    Self links and repeated links don't matter; links with a null don't count.
    An empty table gives an empty result. The rounds end when one changes nothing.
    """
    edges = checkpoint(edges.select("u", "v").where("u <> v").distinct())
    print_of = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    last = print_of(edges)
    if last[0] <= ONE_TASK:
        return edges.repartition(1).mapInArrow(_in_one_task, "node bigint, root bigint")
    while last[0]:
        edges = checkpoint(_large_star(edges))
        edges = checkpoint(_small_star(edges))
        now = print_of(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
