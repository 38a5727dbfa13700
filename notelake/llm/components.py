"""Connected components of an edge table, by alternating large-star and small-star rounds.

Everything stays in tables: edges are pre-aggregated before each shuffle, lineage is cut by reliable checkpoints, and
only a count and two sums reach the driver in a round. Up to ``GATHERED`` distinct edges are joined in one task instead,
as a round is a dozen jobs whatever the number of edges, and the driver keeps the state of all their tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Distinct edges that one task takes, 16 bytes each.
GATHERED = 1 << 20


def apart(df: DataFrame, key: str) -> DataFrame:
    """The same rows, no longer known to be dealt out by ``key``: a join then deals both sides itself and can split a hot key."""
    return df.withColumn(key, F.bitwise_not(F.bitwise_not(key)))


def state(edges: DataFrame) -> tuple:
    """The number of distinct edges and two sums over their hashes: equal for equal sets, and for others with a chance of 2^-64 at most."""
    a, b = F.xxhash64("u", "v"), F.xxhash64("v", "u", F.lit(1))
    return tuple(edges.agg(F.count("*"), F.bit_xor(a), F.sum(F.shiftrightunsigned(b, 24))).first())


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges, and of each the least node that can be reached."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        # a root goes below the least root next to it, then all nodes go to the top of their tree
        a, b = root[a], root[b]
        a, b = np.maximum(a, b)[a != b], np.minimum(a, b)[a != b]
        np.minimum.at(root, a, b)
        while (root != (up := root[root])).any():
            root = up
    return nodes, nodes[root]


def gathered(edges: DataFrame) -> DataFrame:
    """(node, root) by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(k).to_numpy() for k in (0, 1)] for b in batches]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined(*map(np.concatenate, zip(*held)))], names=["node", "root"])

    return edges.repartition(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, *, most: int = GATHERED) -> DataFrame:
    """(node, root) for each node of the edges (u, v), which are longs; root is the least node that can be reached.

    Self edges and repeated edges are harmless; an empty table gives no rows. Nulls are not allowed. Edges beyond
    ``most`` go by rounds.
    """
    now = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = state(now)
    if seen[0] <= most:
        return durable(gathered(now))
    while True:
        # large star: each node sends its larger neighbours to the least of its neighbourhood
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(apart(least, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node sends its smaller neighbours, and itself, to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        new = durable(small.distinct())
        # done when every edge is a leaf's edge to its root and nothing changed
        was, now, seen = seen, new, state(new)
        if seen == was:
            break
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
