"""Connected components of an undirected graph given as edges, without collecting any of it.

Alternating large-star and small-star rounds turn the edges into stars around
the smallest node of each component; after each round every task contracts the
edges that it holds to stars of its own, a bounded number at a time, and a graph
that fits one task is done then. Joins exchange both of their sides, so the adaptive skew join can split
the neighbours of a hub; the minimum per node is a partially aggregated sum over
tasks. Each round is cut by a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import store

#: Edges that a task contracts together: some 50 MB of work space.
_HELD = 500_000


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of ``n`` nodes reaches over links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to the stars that connect the same nodes."""
    held: list[np.ndarray] = []

    def stars() -> pa.RecordBatch:
        nodes, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        held.clear()
        a, b = ends.reshape(2, -1)
        root = forest(a, b, len(nodes))
        at = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_pydict({"a": pa.array(nodes[at]), "b": pa.array(nodes[root[at]])})

    for batch in batches:
        held.append(np.stack([np.asarray(c) for c in batch.columns]))
        if sum(x.shape[1] for x in held) > _HELD:
            yield stars()
    if held:
        yield stars()


def _contract(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_contracted, "a long, b long")


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the smallest of u's neighbours and u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.xxhash64("u").alias("__k"), F.col("u").alias("__u"), F.least("u", "m").alias("m"))
    return pairs.join(least, (F.xxhash64("u") == F.col("__k")) & (F.col("u") == F.col("__u"))).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    near = _with_least(down)
    own = near.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(own).filter("a != b").distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node but the centres has one edge and no centre has one; then nothing can change any more."""
    sides = edges.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select(F.col("b").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    each = sides.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return each.filter("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b); the root is the smallest node of its component."""
    now = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a != b")
    while True:  # rounds shrink the graph until one task can contract what is left, or stars are left: some log2 of its longest path
        raw = store.table(now, "edges")
        tasks = 1 + raw.count() // _HELD  # as many edges in a task as it contracts together
        now = store.table(_contract(raw.coalesce(tasks)), "edges")
        store.drop(raw)
        if tasks == 1 or _is_forest_of_stars(now):
            break
        now = _small_star(_large_star(now))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
