"""A table of the latest result of each key, written by a stream, that a replayed batch doesn't change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


class ResultTable:
    """Changes by batch, and snapshots of what all batches up to one make.

    A batch's changes have a folder of their own, which the same batch replaces when it is
    run again; so a batch counts once however often it is replayed. Readers take the newest
    snapshot and what came after it, and see a batch whole or not at all. A batch costs what it
    changes, not what the table holds; a snapshot is written now and then.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: tuple[str, ...], removed: str | None = None):
        """schema: columns of a change; of changes of a key the last by `order` counts. removed: a boolean column of changes that take the key away."""
        self._spark, self._path, self._schema = spark, path, schema
        self._key, self._order, self._removed = key, list(order), removed

    def _read(self, kind: str, by: str) -> DataFrame:
        schema = f"{self._schema}, {by} long"
        try:
            return self._spark.read.schema(schema).parquet(f"{self._path}/{kind}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self._spark.createDataFrame([], schema)

    def _last(self, changes: DataFrame) -> DataFrame:
        names = [f.name for f in changes.schema]
        last = changes.groupBy(self._key).agg(F.max_by(F.struct(*names), F.struct(*self._order)).alias("x"))
        return last.select(*(F.col("x")[c].alias(c) for c in names))

    def write_batch(self, changes: DataFrame, batch_id: int) -> None:
        """One change for each key that a batch changes; the same batch again replaces itself. Fits foreachBatch."""
        columns = [f.name for f in self._read("changes", "batch").schema][:-1]
        self._last(changes.select(*columns)).write.mode("overwrite").parquet(f"{self._path}/changes/batch={batch_id}")

    def _changes(self, upto: int | None = None) -> tuple[DataFrame, int]:
        snapshots = self._read("snapshots", "upto")
        if upto is not None:
            snapshots = snapshots.where(F.col("upto") < upto)
        newest = snapshots.agg(F.max("upto")).first()[0]
        newest = -1 if newest is None else newest
        new = self._read("changes", "batch").where(F.col("batch") > newest)
        new = new if upto is None else new.where(F.col("batch") <= upto)
        return snapshots.where(F.col("upto") == newest).drop("upto").unionByName(new.drop("batch")), newest

    def read(self) -> DataFrame:
        """The last change of each key, without keys that were taken away."""
        rows = self._last(self._changes()[0])
        return rows.where(~F.coalesce(self._removed, F.lit(False))).drop(self._removed) if self._removed else rows

    def snapshot(self, upto: int) -> None:
        """Writes what all batches up to that one make, removals included, as a late change may still be older than one. Batches up to it must be done."""
        rows, newest = self._changes(upto)
        if newest < upto:
            self._last(rows).write.mode("overwrite").parquet(f"{self._path}/snapshots/upto={upto}")

    def sink(self, every: int = 100) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: writes each batch, and before each `every`-th a snapshot of those before it."""

        def write(changes: DataFrame, batch_id: int) -> None:
            if batch_id and batch_id % every == 0:
                self.snapshot(batch_id - 1)
            self.write_batch(changes, batch_id)

        return write
