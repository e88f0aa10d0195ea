"""Substring dedup: repeated runs of several consecutive sentences go, but for the first.

A run starts (or ends) at each sentence and takes as few sentences, two at least, as
hold LEAST_WORDS words; so any repeated passage of two sentences and LEAST_WORDS words
or more is covered from its first whole sentence to its last by runs of its own.
Runs are hashed once and joined over all documents; a sentence is removed if a run that
covers it isn't the first of its kind and doesn't overlap the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, checkpointed, row_key, saved, utf8

LEAST_WORDS = 16
#: A sentence ends at a line break, at an ideographic full stop, or at blanks behind . ! or ?
_BREAK = re.compile(rb"((?<=[.!?])[\x20\x09-\x0D]+|(?<=\xe3\x80\x82)|\n+)")
BITMAP_WORDS = 1 << 20
_LENGTH_BITS = 24  # of a run's place: its first sentence above, the number of further ones below


def sentences(text: bytes) -> tuple[list[bytes], list[int]]:
    """(parts, places): text cut into sentences and breaks in turn; where a sentence with words stands."""
    parts = _BREAK.split(text)
    return parts, [i for i in range(0, len(parts), 2) if parts[i] and not parts[i].isspace()]


def runs(text: bytes, least_words: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(first, last, hash) of each run, by its first sentence; A-Z lower-cased, blanks as one."""
    parts, places = sentences(text)
    words = [parts[i].lower().split() for i in places]
    norm = [b" ".join(w) for w in words]
    upto = [0]
    for w in words:
        upto.append(upto[-1] + len(w))
    spans, n, end = set(), len(words), 0
    for i in range(n - 1):
        end = max(end, i + 2)
        while end < n and upto[end] - upto[i] < least_words:
            end += 1
        if upto[end] - upto[i] < least_words:
            break
        spans.add((i, end - 1))
    start = 0
    for j in range(1, n):
        while start + 1 < j and upto[j + 1] - upto[start + 1] >= least_words:
            start += 1
        if upto[j + 1] - upto[start] >= least_words:
            spans.add((start, j))
    return [(i, j, xxhash.xxh3_64_intdigest(b" ".join(norm[i : j + 1])) - (1 << 63)) for i, j in sorted(spans)]


def _run_batches(least_words: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [runs(t, least_words) for t in b.column(2).to_pylist()]
            h = np.fromiter((h for own in found for *_, h in own), np.int64)
            at = np.fromiter(((i << _LENGTH_BITS) + j - i for own in found for i, j, _ in own), np.int64)
            of = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column(0).take(of), b.column(1).take(of), pa.array(at)], ["h", "row", "id", "at"])

    return hashed


def cut(text: bytes, gone: list[int]) -> tuple[bytes, int, int]:
    """(text without the runs at the places in gone, sentences, sentences removed)."""
    parts, places = sentences(text)
    drop = {k for at in gone for k in range(at >> _LENGTH_BITS, (at >> _LENGTH_BITS) + (at & (1 << _LENGTH_BITS) - 1) + 1)}
    if not drop:
        return text, len(places), 0
    for k in drop:
        parts[places[k]] = b""
        if places[k] + 1 < len(parts):
            parts[places[k] + 1] = b""
    return b"".join(parts).rstrip(), len(places), len(drop)


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [cut(t, g or []) for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        texts = pa.array([t.decode() for t, *_ in rows], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), texts, pa.array([n for _, n, _ in rows], pa.int64()), pa.array([n for *_, n in rows], pa.int64())], ["doc_id", "text", "n_sentences", "n_removed"])


def _last(at: Column) -> Column:
    return F.shiftright(at, _LENGTH_BITS) + at.bitwiseAND(F.lit((1 << _LENGTH_BITS) - 1))


def dedup_spans(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed) for every row of docs.

    Sentences compare by their words, A-Z lower-cased. Null text counts as empty. First
    is by doc_id, null ones last, then by a hash of doc_id and text, then by place. Rows
    that share a doc_id, or have none, are documents of their own; rows that are equal
    in doc_id and text count as one, and each keeps what that one keeps. Other columns
    aren't read; an empty table gives an empty one. A common run is counted before it is
    shuffled, and its rows meet the first in a join that AQE can split. Runs meet by a
    64-bit hash.
    """
    rows = docs.select(row_key("doc_id", "text").alias("row"), F.col("doc_id").alias("id"), utf8("text").alias("t"))
    found = saved(rows.where(F.length("t") >= 2 * least_words - 1).mapInArrow(_run_batches(least_words), "h long, row long, id long, at long"))
    twice = checkpointed(found.groupBy("h").count().where("count > 1").select("h"))
    # not joined with the exact keys: behind such a join by h, all rows of a common run would be summed up in one task
    shared = among(found, "h", twice, BITMAP_WORDS)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "at")
    firsts = shared.groupBy("h").agg(F.min(place).alias("first")).select("h", F.col("first.row").alias("first_row"), _last(F.col("first.at")).alias("first_end"))
    later = shared.join(firsts, "h").where((F.col("row") != F.col("first_row")) | (F.shiftright("at", _LENGTH_BITS) > F.col("first_end")))
    gone = later.groupBy("row").agg(F.collect_set("at").alias("gone"))
    full = docs.select("doc_id", utf8("text").alias("t"), row_key("doc_id", "text").alias("row")).join(gone, "row", "left")
    return full.select("doc_id", "t", "gone").mapInArrow(_cut_batches, "doc_id long, text string, n_sentences long, n_removed long")
