"""Connected components of a link table by alternating large and small stars.

Every step is a minimum per node and a join with it, so no neighbour list is ever
gathered; a node with very many links is one hot key of an inner join, which
adaptive execution splits. Steps are written to the shared folder.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches; links has long columns a, b."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links, before = materialize(links.distinct()), None
    while (now := _mark(links)) != before:
        before = now
        links = materialize(_small_star(_large_star(links)))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(links: DataFrame):
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node are hung under its smallest neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    hung = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and itself, are hung under the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
    hung = links.join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label over the components that the links a-b make; label holds positions of itself."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest one of its component: as connected as the links given, but few."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = settle(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def strongest(a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b, distance) of a spanning forest that prefers small distances."""
    at = strongest_at(a, b, distance)
    return a[at], b[at], distance[at]


def strongest_at(a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Positions of the links of a spanning forest that prefers small distances: every component takes its nearest link out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    order = np.lexsort((np.maximum(x, y), np.minimum(x, y), distance))
    x, y = x[order], y[order]
    label, taken = np.arange(len(nodes)), np.zeros(len(x), dtype=bool)
    while True:
        out = np.flatnonzero(label[x] != label[y])
        if len(out) == 0:
            return order[taken]
        first = np.full(len(nodes), len(x))
        np.minimum.at(first, label[x[out]], out)
        np.minimum.at(first, label[y[out]], out)
        now = np.unique(first[first < len(x)])
        taken[now] = True
        label = settle(label, x[now], y[now])
