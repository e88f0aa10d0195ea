"""Whitening of vectors by principal components, with moments merged by Chan's formula.

Each partition makes count, local mean and centred scatter of its vectors; two of these are
merged by the difference of their means, level by level, so that nothing is lost to
cancellation however far the vectors lie from zero. The driver gets one matrix, of length
times length, whose eigenvectors are the components. A second pass does the same with the
whitened vectors and says how far their covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import blocks, commonest, tree_reduced, usable

MOST_COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: From here on a scaled component isn't an exact integer any more.
TOO_LARGE = 2.0**52


def shifted(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + SHIFT as integers; components too large for that are an error."""
    scaled = np.floor(vectors * SCALE)
    if scaled.size and np.abs(scaled).max() >= TOO_LARGE:
        raise OverflowError("components are too large to be scaled to exact integers")
    return scaled.astype(np.int64) + SHIFT


#: (count, mean, centred scatter, exact sums as Python integers) of vectors.
Moments = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def moments(x: np.ndarray) -> Moments:
    mean = x.mean(0)
    centred = x - mean
    sums = x.sum(0).astype(object) if np.abs(x).max() < 2**50 else x.astype(object).sum(0)
    return len(x), mean, centred.T @ centred, sums


def merged(a: Moments, b: Moments) -> Moments:
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n), a[3] + b[3]


def _by_length(batches: Iterable[pa.RecordBatch]) -> dict[int, Moments] | None:
    out: dict[int, Moments] = {}
    for b in batches:
        for _, length, vectors in blocks(b, 0):
            here = moments(shifted(vectors))
            out[length] = merged(out[length], here) if length in out else here
    return out or None


@dataclass
class Whitener:
    """What turns vectors of a length into whitened components, from the moments of the fit list.

    components: (length, k) unit vectors; spread: their standard deviations, 0 for a component
    along which all vectors agree; explained: shares of the trace (nan if that is 0).
    """

    n: int
    length: int
    floor: np.ndarray
    rest: np.ndarray
    sums: np.ndarray
    components: np.ndarray
    spread: np.ndarray
    explained: np.ndarray

    @staticmethod
    def of(m: Moments, most: int = MOST_COMPONENTS) -> Whitener:
        n, mean, scatter, sums = m
        values, vectors = np.linalg.eigh(scatter / n)
        k = min(most, len(values))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1][:, :k]
        turn = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
        flat = values <= len(values) * np.finfo(float).eps * max(values[0], mean.max() ** 2 * np.finfo(float).eps)
        trace = np.trace(scatter) / n
        share = np.where(flat, 0, values)[:k] / trace if trace > 0 and not flat.all() else np.full(k, np.nan)
        floor = np.array([s // n for s in sums], np.int64)
        rest = np.array([s % n for s in sums], np.float64)
        return Whitener(n, len(values), floor, rest, sums, vectors * turn, np.sqrt(np.where(flat, 0, values))[:k], share)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of k doubles; nan along a component without spread."""
        centred = (x - self.floor) - self.rest / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.spread > 0, (centred @ self.components) / self.spread, np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - sums)^2 of each row, exact; None where it doesn't fit a long."""
        with np.errstate(over="ignore"):
            near = ((np.float64(self.n) * (x - self.floor) - self.rest) ** 2).sum(1)
            rest = np.array([int(s) % self.n for s in self.sums], np.int64)
            exact = ((np.int64(self.n) * (x - self.floor) - rest) ** 2).sum(1).tolist()
        for i in np.flatnonzero(near >= 2.0**61):
            big = sum((self.n * int(v) - int(s)) ** 2 for v, s in zip(x[i], self.sums)) if near[i] < 2.0**64 else 2**63
            exact[i] = big if big < 2**63 else None
        return exact


def fit(rows: DataFrame, vector: str = "embedding", most: int = MOST_COMPONENTS) -> Whitener | None:
    """The whitener of all usable vectors of the commonest length (on ties the longer); None if there are none."""

    def merge(a: dict, b: dict) -> dict:
        return {k: merged(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in {*a, *b}}

    found = tree_reduced(rows.where(usable(vector)).select(vector), _by_length, merge)
    return Whitener.of(found[commonest({k: m[0] for k, m in found.items()})], most) if found else None


def identity_error(rows: DataFrame, known: Whitener, vector: str = "embedding") -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over the components with a spread."""
    live = known.spread > 0
    if not live.any():
        return None

    def partial(batches: Iterable[pa.RecordBatch]) -> Moments | None:
        out = None
        for b in batches:
            for _, _, vectors in blocks(b, 0):
                here = moments(known.whitened(shifted(vectors))[:, live])
                out = merged(out, here) if out else here
        return out

    n, _, scatter, _ = tree_reduced(_own(rows, known, vector).select(vector), partial, merged)
    return float(np.abs(scatter / n - np.eye(int(live.sum()))).max())


def _own(rows: DataFrame, known: Whitener, vector: str) -> DataFrame:
    return rows.where(usable(vector) & (F.size(vector) == known.length))


def transform(rows: DataFrame, known: Whitener, vector: str = "embedding") -> DataFrame:
    """The rows with a usable vector of the fitted length, with deviation and whitened (array of doubles), without the vector."""
    keep = [c for c in rows.columns if c not in (vector, "deviation", "whitened")]
    kept = _own(rows, known, vector).select(*keep, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some, _, vectors in blocks(b, len(keep)):
                x = shifted(vectors)
                others = b.select(keep).take(pa.array(some)).columns if keep else []
                white = pa.array(list(known.whitened(x)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*others, pa.array(known.deviations(x), pa.int64()), white], [*keep, "deviation", "whitened"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep] + ["deviation long", "whitened array<double>"])
    return kept.mapInArrow(run, schema)


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", most: int = MOST_COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each usable row of rows (id, vector) and component.

    Rows whose vector is null or empty or holds null or non-finite entries go, and so do
    those of another length than the commonest (on ties the longer). Null and repeated ids
    are rows like others; repeated rows count as often as they stand. A component along
    which all vectors agree has whitened null and explained 0 (null if they agree along all),
    and doesn't count in identity_error (null if none counts). deviation is null where it
    doesn't fit a long. An empty table gives an empty one; other columns don't matter. Entries
    beyond 2^42 are an error. Of a component's two signs that is taken which makes its
    largest entry positive.
    """
    rows = rows.select(id, vector)
    known = fit(rows, vector, most)
    if known is None:
        return rows.limit(0).select(id, F.expr("0 component"), F.expr("0L n"), F.expr("0L deviation"), F.expr("0D whitened"), F.expr("0D explained"), F.expr("0D identity_error"))
    error = identity_error(rows, known, vector)
    share = F.array(*(F.lit(None if np.isnan(s) else float(s)).cast("double") for s in known.explained))
    out = transform(rows, known, vector).select(id, "deviation", F.posexplode("whitened").alias("place", "white"))
    return out.select(
        id,
        (F.col("place") + 1).alias("component"),
        F.lit(known.n).cast("long").alias("n"),
        "deviation",
        F.when(~F.isnan("white"), F.col("white")).alias("whitened"),
        F.get(share, "place").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
