"""What the training-data operators share: tables, shared storage, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

#: A word, wherever a contract speaks of words: a run of non-blank characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name, spread=name in ("documents", "pages"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors are one process, falls back on a temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="discern-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once, keep the rows in the shared folder and cut the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a compressed columnar table in the shared folder, and its path; cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame) -> DataFrame:
    """As checkpointed(), but as a compressed columnar table (for wide rows)."""
    return written(df)[0]


def emptied(spark: SparkSession, path: str) -> None:
    """Frees a written table that nothing reads any more; its folder stays, with no row."""
    spark.createDataFrame([], "none int").write.mode("overwrite").parquet(path)


def utf8(text: str) -> Column:
    """Text as bytes (null: empty), so that Python tasks needn't decode it."""
    return F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))


def binned_quantile(bins: list[tuple[float, int]], q: float) -> float | None:
    """The smallest bin value that at least the share q of the counts doesn't exceed."""
    total, run = sum(n for _, n in bins), 0
    for value, n in sorted(bins):
        run += n
        if run >= q * total:
            return value
    return None


def row_key(id: str, text: str) -> Column:
    """A row is known by its id and text: rows that share an id stay apart, and so do rows without one."""
    return F.xxhash64(id, text)


def bit_of(h: Column) -> Column:
    """The bit that the lowest six bits of a hash name."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def among(rows: DataFrame, key: str, known: DataFrame, words: int = 1 << 18, certain: bool = True) -> DataFrame:
    """rows without most of those whose key, a 64-bit hash, isn't in known (a column of that name).

    known is broadcast as a bitmap of so many words, which can't grow: the more keys,
    the fewer rows it drops. With certain=False all rows stay, with a column hit that is
    false if the key can't be in known.
    """
    word = F.pmod(F.shiftright(key, 6), F.lit(words))
    bitmap = known.groupBy(word.alias("__word")).agg(F.bit_or(bit_of(F.col(key))).alias("__bits"))
    near = rows.withColumn("__word", word).join(F.broadcast(bitmap), "__word", "inner" if certain else "left")
    hit = F.coalesce(F.col("__bits").bitwiseAND(bit_of(F.col(key))) != 0, F.lit(False))
    return (near.where(hit) if certain else near.withColumn("hit", hit)).drop("__word", "__bits")


def slices(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold `size` bytes at most (or one text)."""
    lo = held = 0
    for i, t in enumerate(texts):
        if i > lo and held + len(t) > size:
            yield lo, i
            lo, held = i, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)
