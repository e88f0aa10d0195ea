"""What the operators on vectors share: which rows count, blocks of them, merging over partitions."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a batch that are worked on at once, so that a task's memory doesn't follow the batch size of the session.
BLOCK = 2048


def usable(vector: str) -> Column:
    """Neither null nor empty, and without null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


def blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[slice, int, np.ndarray]]:
    """(rows, length, vectors as doubles) for each length that vectors of a batch have, BLOCK rows at most; rows are row numbers."""
    lists = batch.column(column)
    sizes = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    for length in np.unique(sizes):
        rows = np.flatnonzero(sizes == length)
        for lo in range(0, len(rows), BLOCK):
            some = rows[lo : lo + BLOCK]
            yield some, int(length), flat[(ends[some] - length)[:, None] + np.arange(length)]


def commonest(counts: dict[int, int]) -> int:
    """The commonest length of vectors; on ties the longer one."""
    return max(counts, key=lambda k: (counts[k], k))


def tree_reduced(rows: DataFrame, partial: Callable[[Iterable[pa.RecordBatch]], object], merge: Callable):
    """merge() over what partial() makes of the batches of each partition (None: nothing), level by level; None without rows.

    Each partition makes one object of bounded size, and the driver gets the last few merged ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = partial(batches)
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["made"])

    def add(a, b):
        return b if a is None else a if b is None else merge(a, b)

    return rows.mapInArrow(run, "made binary").rdd.map(lambda r: pickle.loads(r[0])).treeAggregate(None, add, add)
