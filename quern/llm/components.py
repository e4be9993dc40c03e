"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quern.llm.common import materialize

#: A guard: rounds needed grow with the logarithm of the number of nodes.
MAX_ROUNDS = 60


def local_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and the edges (a[i], b[i]): the smallest node of each one's component.

    Labels are roots at the start of every round; only roots are moved, each to the smallest root it has an edge
    to, and an edge is done with when both its ends have one root.
    """
    label = np.arange(n)
    while len(a):
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while not np.array_equal(label, up := label[label]):
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and all its smaller neighbours are linked to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    low = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, put: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """edges (a, b) of integers -> (node, root): each node's smallest reachable node, for all that have an edge.

    Alternating large and small stars until nothing changes, each round written to the shared folder by ``put``. Loops
    (a = b) and edges with a null are left out; nodes without another edge don't appear. The minimum per node
    is aggregated before the shuffle, and the joins on a node of very many edges are ones that adaptive
    execution splits.
    """
    edges = put(edges.select("a", "b").where("a <> b").distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not found[0] or tuple(found) == seen:
            break
        seen = tuple(found)
        edges = put(_small_star(_large_star(edges)))
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
