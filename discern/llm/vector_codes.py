"""Product-quantisation codes of vectors, in integers, with exponion search for the nearest entry.

A vector is cut into equal parts, and each part is replaced by the number of the nearest
entry of a codebook. The search starts at the part's entry of the round before, at squared
distance u. An entry as near as that one lies, by the triangle inequality, within 2 * sqrt(u)
of it; so only the neighbours of the start entry with a squared distance of at most 4 * u
are scanned, in order of that distance. All of it is integer arithmetic, so the radius is
exact, and ties go to the lower index.

A round needs the sums and counts of each entry: each partition makes them, they are merged
level by level, and the driver divides. The codes of a round aren't stored; a task goes
through the rounds again from the codebooks, each search starting where the one before ended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import blocks, commonest, tree_reduced, usable

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Up to so many labels their sums are broadcast (about 2 MB); beyond that rows are joined by label and salt.
MOST_BROADCAST, SALTS = 50_000, 32


def quantised(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as integers. Components so large that a vector's squared distance wouldn't fit a long are an error."""
    scaled = np.floor(vectors * scale)
    if scaled.size and 8.0 * vectors.shape[1] * np.abs(scaled).max() ** 2 >= 2.0**63:
        raise OverflowError("components are too large for exact distances")
    return scaled.astype(np.int64)


class Neighbours:
    """The entries of a codebook of shape (parts, entries, length), and for each entry the others by distance, itself included."""

    def __init__(self, book: np.ndarray):
        self.book = book
        between = ((book[:, :, None, :] - book[:, None, :, :]) ** 2).sum(3)
        self.order = np.argsort(between, axis=2, kind="stable")
        self.distance = np.take_along_axis(between, self.order, 2)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance), both (rows, parts), of x (rows, parts, length), searched from the entries `start`."""
        rows, parts, length = x.shape
        x, part, start = x.reshape(-1, length), np.tile(np.arange(parts), rows), start.ravel()
        best, least = start.copy(), ((x - self.book[part, start]) ** 2).sum(1)
        radius, live = 4 * least, np.arange(len(x))
        for rank in range(self.book.shape[1]):
            live = live[self.distance[part[live], start[live], rank] <= radius[live]]
            if not len(live):
                break
            entry = self.order[part[live], start[live], rank]
            found = ((x[live] - self.book[part[live], entry]) ** 2).sum(1)
            better = (found < least[live]) | ((found == least[live]) & (entry < best[live]))
            best[live[better]], least[live[better]] = entry[better], found[better]
        return best.reshape(rows, parts), least.reshape(rows, parts)


def _searched(x: np.ndarray, path: list[Neighbours]) -> tuple[np.ndarray, np.ndarray]:
    """Entries and distances under the last codebook of path; each search starts at the result of the one before."""
    at, distance = np.zeros(x.shape[:2], dtype=np.int64), None
    for known in path:
        at, distance = known.nearest(x, at)
    return at, distance


def _least_rows(batches: Iterable[pa.RecordBatch], entries: int) -> dict | None:
    """{length: (count, {id: vector})} with the vectors of the smallest ids; of rows that share an id the smallest vector."""
    out: dict = {}
    for b in batches:
        ids = b.column(0).to_pylist()
        for rows, length, vectors in blocks(b, 1):
            here: dict = {}
            wanted = set(sorted({ids[r] for r in rows if ids[r] is not None})[:entries])
            for r, v in zip(rows, vectors):
                if ids[r] in wanted:
                    v = tuple(v)
                    here[ids[r]] = min(v, here.get(ids[r], v))
            out[length] = _merged_least(out.get(length, (0, {})), (len(rows), here), entries)
    return out or None


def _merged_least(a: tuple, b: tuple, entries: int) -> tuple:
    both = {k: min(a[1].get(k, v), v) for k, v in b[1].items()} | {k: v for k, v in a[1].items() if k not in b[1]}
    return a[0] + b[0], {k: both[k] for k in sorted(both)[:entries]}


def _sums(batches: Iterable[pa.RecordBatch], books: list[np.ndarray], scale: int) -> tuple | None:
    """(sums, counts) of the parts that go to each entry of the last codebook."""
    path = [Neighbours(b) for b in books]
    parts, entries, length = books[-1].shape
    sums, counts = np.zeros((parts * entries, length), np.int64), np.zeros(parts * entries, np.int64)
    for b in batches:
        for _, _, vectors in blocks(b, 0):
            x = quantised(vectors, scale).reshape(len(vectors), parts, length)
            cell = (_searched(x, path)[0] + np.arange(parts) * entries).ravel()
            np.add.at(sums, cell, x.reshape(-1, length))
            counts += np.bincount(cell, minlength=len(counts))
    return sums, counts


def train(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """The codebooks before the first and after each round, each (parts, entries, length); empty without a usable vector.

    A codebook starts as the parts of the `entries` smallest ids (null ids never start one; where no
    row has an id, there is no codebook). An entry becomes the floor of its parts' mean; an unused one stays.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part: at most 256 entries")

    def merge(a: dict, b: dict) -> dict:
        return {k: _merged_least(a.get(k, (0, {})), b.get(k, (0, {})), entries) for k in {*a, *b}}

    kept = rows.where(usable(vector))
    found = tree_reduced(kept.select(id, vector), lambda batches: _least_rows(batches, entries), merge)
    if not found:
        return []
    length = commonest({k: n for k, (n, _) in found.items()})
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    first = found[length][1]
    if not first:
        return []
    start = np.array([first[k] for k in sorted(first)])
    books = [np.ascontiguousarray(quantised(start, scale).reshape(len(start), parts, -1).transpose(1, 0, 2))]
    same = kept.where(F.size(vector) == length).select(vector)
    for _ in range(rounds):
        so_far = list(books)
        sums, counts = tree_reduced(same, lambda batches: _sums(batches, so_far, scale), lambda a, b: (a[0] + b[0], a[1] + b[1]))
        mean = sums // np.maximum(counts, 1)[:, None]
        last = books[-1].reshape(mean.shape)
        books.append(np.where(counts[:, None] > 0, mean, last).reshape(books[-1].shape))
    return books


def encode(rows: DataFrame, books: list[np.ndarray], vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The rows with a usable vector of the codebooks' length, with code (hex) and error, without the vector.

    books: as from train(); columns of the names code and error are replaced.
    """
    keep = [c for c in rows.columns if c not in (vector, "code", "error")]
    if not books:
        return rows.limit(0).select(*keep, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    parts, _, length = books[-1].shape
    kept = rows.where(usable(vector) & (F.size(vector) == parts * length)).select(*keep, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = [Neighbours(b) for b in books]
        for b in batches:
            for some, _, vectors in blocks(b, len(keep)):
                x = quantised(vectors, scale).reshape(len(vectors), parts, length)
                at, distance = _searched(x, path)
                codes = [bytes(r).hex() for r in at.astype(np.uint8)]
                others = b.select(keep).take(pa.array(some)).columns if keep else []
                yield pa.RecordBatch.from_arrays([*others, pa.array(codes), pa.array(distance.sum(1))], [*keep, "code", "error"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep] + ["code string", "error long"])
    return kept.mapInArrow(run, schema)


def with_label_error(coded: DataFrame, label: str = "label", salt_by: str = "vec_id") -> DataFrame:
    """coded (label, error, ...) with label_error, the sum of error over rows with an equal label, nulls together.

    Sums are pre-aggregated. Few labels are broadcast, so that no row moves; else rows meet
    them by label and salt, as one label may hold a third of all rows.
    """
    sums = coded.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error"))
    few = sums.select("__label").limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    if few:
        return coded.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col("__label"))).drop("__label")
    salted = coded.withColumn("__salt", F.pmod(F.xxhash64(salt_by, "error"), F.lit(SALTS)))
    spread = sums.withColumn("__own", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__salt") == F.col("__own"))).drop("__label", "__salt", "__own")


def sha256(books: list[np.ndarray]) -> str:
    """Of the last codebook's components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books[-1].ravel().tolist())).encode()).hexdigest() if books else ""


def codes(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of each row of rows (id, vector, label) with a usable vector.

    Rows whose vector is null or empty or holds null or non-finite components go, and so do
    those of another length than the commonest (on ties the longer). Rows with a null id
    are coded, but start no entry; of rows that share an id, the smallest vector starts one;
    repeated rows count as often as they stand. With fewer than ENTRIES ids the codebooks are
    smaller. Equal entries and equal distances go to the lower index. Null labels are one
    label. An empty table, or one without any id, gives an empty one. Other columns don't
    matter. A length that isn't divisible by PARTS, and components beyond the range of exact
    distances, are errors.
    """
    rows = rows.select(id, vector, label)
    books = train(rows, id, vector)
    coded = with_label_error(encode(rows, books, vector), label, id)
    return coded.select(id, "code", "error", "label_error", F.lit(sha256(books)).alias("codebooks_sha256"))
