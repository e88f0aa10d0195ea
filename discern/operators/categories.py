"""Data categories of a document and the first sentences that show them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.hits import has_any, with_hits
from ..functions.patterns import computed_sql
from ..functions.text import sentences


def with_categories(docs: DataFrame, hits: str) -> DataFrame:
    """docs with data_collected and data_evidence, maps from each category in order, from an array column of the hits of its sentences.

    Evidence is the first sentences in document order, not made distinct. All of it
    happens inside the row: no shuffle, no join.
    """
    every = [p for patterns in rules.CATEGORIES.values() for p in patterns]
    rows = computed_sql(docs, {"__shown": f"filter({hits}, h -> {has_any('h.', every)})"})
    first = {k: f"transform(slice(filter(__shown, h -> {has_any('h.', p)}), 1, {rules.MAX_EVIDENCE}), h -> h.text)" for k, p in rules.CATEGORIES.items()}
    rows = computed_sql(rows, {"data_evidence": "map(" + ", ".join(f"'{k}', {v}" for k, v in first.items()) + ")"}).drop("__shown")
    return rows.withColumn("data_collected", F.expr("transform_values(data_evidence, (k, v) -> size(v) > 0)"))


def categories(docs: DataFrame) -> DataFrame:
    """(doc_id, data_collected, data_evidence) of docs (doc_id, text)."""
    rows = with_hits(docs.select("doc_id", sentences(F.col("text")).alias("s")), "s")
    return with_categories(rows, "hits").select("doc_id", "data_collected", "data_evidence")
