"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table of fewer bytes a core may stand in fewer row groups than there are cores.
SMALL = 64 << 20


def _is_small(df: DataFrame, cores: int) -> bool:
    """Fewer files than cores, and so little data that they may hold a row group each. Sizes come from the plan, without a scan."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size < cores * SMALL and len(df.inputFiles()) < cores


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """The table `name` of a folder; with `spread`, a small one is dealt out to all cores.

    A row group is read by one task, however many tasks its file is split into, and a small
    file often has one. Larger tables, and those of many files, are read as they are stored.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and _is_small(df, cores) else df
