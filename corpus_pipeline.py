"""From documents to a mixed training corpus, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and
returns the columns of documents; the last returns the mix, a row for each block. Any
column of docs may hold nulls, rows may repeat, tables may be empty, and columns beyond
those of documents stay through all stages but the last, whatever their names; what
becomes of each case is said at the stage or at the operator that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discern.llm import decontam, langid, line_dedup, mixing, simhash
from discern.llm.common import emptied, table, written

#: No SQL: string kernels, SimHash and the mix are tested against brute force.
ORACLE_SQL = None

#: Rows that a Python task gets at a time. Texts are long, and an executor keeps the memory of its largest batches.
BATCH_ROWS = 1000


def _batched(spark: SparkSession) -> None:
    """Sets BATCH_ROWS in the session, unless it asks for smaller batches; it holds when a stage's result is computed."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = int(spark.conf.get(name))
    if own <= 0 or own > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay, with the predicted one as lang.

    Null texts and texts without a letter go. Without a row that has a language there is
    nothing to learn, and all stay as they are.
    """
    _batched(spark)
    return langid.recognised(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents of which no word is left, null texts among them. n_chars is counted anew."""
    clean = line_dedup.dedup_lines(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays; of repeated rows one, of null and empty texts one."""
    _batched(spark)
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; each row is judged by its text, and null texts stay."""
    _batched(spark)
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all documents by source, a row for each block; null and wordless texts give none, a null source is one of its own."""
    _batched(spark)
    return mixing.mixed_blocks(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again; a table goes once the next is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir))
        if last:
            emptied(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
