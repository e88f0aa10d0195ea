"""Connected components of an edge list, by alternating large and small stars.

A list so short that one partition of a shuffle would hold it needs no rounds, each of
which costs as many tasks as the shuffles have partitions: a task joins its edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

FEW = 1 << 17  # edges that a task joins at most, 2 MB of them


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root, the smallest node that each node reaches, with edges (a, b) more."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root[root] != root).any():
            root = root[root]


def _joined_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (a, b) as stars: each node but the smallest of its component, and that."""
    edges = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches]
    if edges:
        nodes, at = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
        root = joined(np.arange(len(nodes)), *at.reshape(2, -1))
        moved = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: each with b < a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component) for every node of an edge (a long, b long).

    component is the smallest node that can be reached. Nodes without an edge,
    self-loops included, don't occur in the result. Each round is written to the
    shared folder; the driver sees two numbers a round. A hub's edges are never
    gathered: its minimum is pre-aggregated and joined back, a join that AQE splits.
    Lists of up to `few` distinct edges are joined by one task instead, longer ones never.
    """
    edges = checkpointed(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = _state(edges)
    while seen[0] > few:
        edges = checkpointed(_small_star(_large_star(edges).where("a <> b").distinct()).distinct())
        now = _state(edges)
        if now == seen:
            break
        seen = now
    if 0 < seen[0] <= few:
        edges = checkpointed(edges.coalesce(1).mapInArrow(_joined_batches, "a long, b long"))
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
