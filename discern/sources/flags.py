"""The service's one-row flag file and key-value settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

FLAG_SCHEMA = "enabled boolean"
#: Columns of stored changes of settings.
STORED = {"key": "string", "value": "string", "seq": "long"}
DEFAULTS = {"analyzer.enabled": "false"}


def read_flag(spark: SparkSession, path: str) -> DataFrame:
    """One row (enabled); false if the file is missing, empty or no JSON."""
    none = spark.range(1).select(F.lit(False).alias("fallback"))
    try:
        rows = spark.read.schema(FLAG_SCHEMA).option("mode", "PERMISSIVE").option("multiLine", True).json(path)
    except AnalysisException:
        rows = spark.createDataFrame([], FLAG_SCHEMA)
    found = rows.agg(F.coalesce(F.first("enabled", ignorenulls=True), F.lit(False)).alias("enabled"))
    return none.crossJoin(found).select(F.coalesce("enabled", "fallback").alias("enabled"))


def write_flag(spark: SparkSession, path: str, enabled: bool | None) -> None:
    """Replaces the flag (null: false); the file is indented by two blanks."""
    text = F.concat(F.lit('{\n  "enabled": '), F.lit(bool(enabled)).cast("string"), F.lit("\n}"))
    spark.range(1).select(text).coalesce(1).write.mode("overwrite").text(path)


def store(changes: DataFrame, path: str) -> None:
    """Adds changes (key, value, seq) of settings to a table; the largest seq of a key counts."""
    changes.select(*(F.col(c).cast(t).alias(c) for c, t in STORED.items())).write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All changes (key, value, seq) that were stored; none where there is no table yet."""
    schema = ", ".join(map(" ".join, STORED.items()))
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def settings(spark: SparkSession, stored: DataFrame | None = None) -> DataFrame:
    """(key, value): stored settings over defaults; the last stored row of a key counts (by seq, where it has one)."""
    defaults = spark.createDataFrame(sorted(DEFAULTS.items()), "key string, default string")
    if stored is None:
        return defaults.select("key", F.col("default").alias("value"))
    order = F.col("seq") if "seq" in stored.columns else F.lit(0)
    last = stored.groupBy("key").agg(F.max_by("value", order).alias("value"))
    return last.join(defaults, "key", "full").select("key", F.coalesce("value", "default").alias("value"))
