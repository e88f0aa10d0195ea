"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are TF-IDF rows over the words of the benchmark (no other
word can raise a cosine with an item, and the width stays bounded by the benchmark). A
randomised, single-pass SVD, summed over all partitions, gives a low-rank space; windows
of each document whose latent cosine with an item is high are candidates, which a
longest common subsequence of words and a check of the item's answer words decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

SEGMENT = 8  # words; windows are runs of segments
LEAST_PART = 0.35
LEAST_ANSWER = 0.5
PASSAGE = 4  # segments in a passage of the decomposition
PIECE = 32  # rows of a run that are added one by one
GATHERED = 1 << 17  # words whose vectors are gathered at a time
WINDOWS, ITEMS = 1 << 14, 1 << 11  # compared at a time
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased words; ASCII punctuation separates them."""
    return text.translate(_WORDS).split()


def lcs_length(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit for each word of a."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & masks.get(w, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@dataclass
class Item:
    item_id: object
    words: list[bytes]
    answer: list[bytes]


@dataclass
class Index:
    vocab: dict[bytes, int]
    items: list[Item]
    idf: np.ndarray
    project: np.ndarray  # words x k: idf times right singular vectors
    latent: np.ndarray  # items x k, of length 1
    length: np.ndarray  # of each item, before
    segments: np.ndarray  # of each item
    least_cosine: float
    least_lcs: float


def _tokens(texts: list[bytes], vocab: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
    """(word ids, segment of each, the texts' words, first segment of each text), of words of the vocabulary."""
    split = [words(t) for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    base = np.r_[0, np.cumsum(-(-n // SEGMENT))]
    ids = np.fromiter(map(vocab.get, chain.from_iterable(split), repeat(-1)), np.int32, int(n.sum()))
    place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    seg = np.repeat(base[:-1], n) + place // SEGMENT
    known = ids >= 0
    return ids[known], seg[known], split, base


def _run_sums(rows: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of rows[ids] over the runs of ids that start at `at`.

    All runs advance together, a whole row at a time; long ones are cut into pieces,
    whose sums are summed up again.
    """
    size = np.diff(np.r_[at, len(ids)])
    pieces = -(-size // PIECE)
    first = np.cumsum(pieces) - pieces
    start = np.repeat(at - PIECE * first, pieces) + PIECE * np.arange(pieces.sum())
    length = np.minimum(PIECE, np.repeat(at + size, pieces) - start)
    order = np.argsort(-length, kind="stable")
    start = start[order]
    sums = rows[ids[start]]
    longer = len(length) - np.cumsum(np.bincount(length, minlength=PIECE + 1))
    for k in range(1, int(length.max(initial=0))):
        sums[: longer[k]] += rows[ids[start[: longer[k]] + k]]
    out = np.empty_like(sums)
    out[order] = sums
    return out if len(out) == len(at) else _run_sums(out, np.arange(len(out)), first)


def _summed(rows: np.ndarray, ids: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that ids name by ascending group, as n rows; a bounded number is gathered at a time."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    for lo in range(0, len(ids), GATHERED):
        g = group[lo : lo + GATHERED]
        at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        out[g[at]] += _run_sums(rows, ids[lo : lo + GATHERED], at)
    return out


def _frequency_batches(vocab: dict[bytes, int]):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocab) + 1, np.int64)  # the last counts documents
        for b in batches:
            for t in b.column(0).to_pylist():
                total[[vocab[w] for w in vocab.keys() & set(words(t))]] += 1
                total[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["term", "n"])

    return counted


def _sketch(ids: np.ndarray, passage: np.ndarray, idf: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """A'AΩ of the passages (A: their TF-IDF rows, scaled to length 1)."""
    out = np.zeros_like(omega)
    if not len(ids):
        return out
    starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    z = _run_sums(omega * idf[:, None], ids, starts) / np.add.reduceat(idf[ids] ** 2, starts)[:, None]
    row = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(ids)]))
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    out[s[at]] = _run_sums(z, row[order], at) * idf[s[at], None]
    return out


def _sketch_batches(vocab: dict[bytes, int], idf: np.ndarray, omega: np.ndarray):
    names = [f"c{i}" for i in range(omega.shape[1])]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(omega.shape, np.float64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in slices(texts):
                ids, seg, _, _ = _tokens(texts[lo:hi], vocab)
                for at in range(0, len(ids), GATHERED):
                    total += _sketch(ids[at : at + GATHERED], seg[at : at + GATHERED] // PASSAGE, idf, omega)
        rows = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(total[rows, i]) for i in range(omega.shape[1]))], ["term", *names])

    return summed


def build(docs: DataFrame, benchmark: DataFrame, rank: int = 64, oversample: int = 16, least_cosine: float = 0.5, least_lcs: float = 0.65, most_items: int = 100_000, seed: int = 11) -> Index | None:
    """The index of the benchmark's items in a space that all of docs span.

    benchmark: item_id, text and, if it has one, answer. It is a reference set that the
    driver holds; more than most_items is an error, to be run in parts. Each word of an
    item keeps a weight above zero however many documents hold it, so an item stays
    searchable if all of them do. Null and empty items are left out; None without any
    item.
    """
    with_answer = "answer" in benchmark.columns
    rows = benchmark.where("text is not null").limit(most_items + 1).collect()
    if len(rows) > most_items:
        raise ValueError(f"more than {most_items} benchmark items: pass them in parts")
    items = [Item(r["item_id"], words(r["text"].encode()), words((r["answer"] or "").encode()) if with_answer else []) for r in rows]
    items = [i for i in items if i.words]
    if not items:
        return None
    vocab = {w: i for i, w in enumerate(sorted({w for i in items for w in i.words}))}
    texts = docs.where("text is not null").select(utf8("text").alias("t"))
    seen = texts.mapInArrow(_frequency_batches(vocab), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(vocab) + 1)
    df[seen["term"].to_numpy()] = seen["n"].to_numpy()
    idf = np.log(1 + (df[-1] + 1) / (df[:-1] + 1)).astype(np.float32)
    size = min(rank + oversample, len(vocab))
    omega = np.random.default_rng(seed).standard_normal((len(vocab), size)).astype(np.float32)
    schema = "term long, " + ", ".join(f"c{i} double" for i in range(size))
    sums = texts.mapInArrow(_sketch_batches(vocab, idf, omega), schema).groupBy("term").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(size))).toPandas()
    y = np.zeros((len(vocab), size))
    y[sums["term"].to_numpy()] = sums.drop(columns="term").to_numpy()
    flat = [(vocab[w], k) for k, i in enumerate(items) for w in i.words]
    ids, own = (np.array(x, np.int32) for x in zip(*flat))
    mine = _sketch(ids, own, idf, omega).astype(np.float64)
    # the items take part with the same weight as all passages together, so that the space separates them
    y = y / max(np.linalg.norm(y), 1e-9) + mine / max(np.linalg.norm(mine), 1e-9)
    values, vectors = np.linalg.eigh((omega.T @ y + y.T @ omega) / 2)
    keep = values > 1e-9 * max(values.max(), 1e-12)
    u, _, _ = np.linalg.svd(y @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    project = (idf[:, None] * u[:, :rank]).astype(np.float32)
    latent = _summed(project, ids, own, len(items))
    length = np.maximum(np.linalg.norm(latent, axis=1), 1e-9)
    latent /= length[:, None]
    for item in items:
        if not item.answer:  # without an answer of its own, an item is known by its rarest words
            item.answer = sorted(set(item.words), key=lambda w: (-idf[vocab[w]], w))[:6]
    segments = np.array([max(1, round(len(i.words) / SEGMENT)) for i in items])
    return Index(vocab, items, idf, project, latent, length, segments, least_cosine, least_lcs)


def verify(item: Item, region: list[bytes], least_lcs: float) -> tuple[float, float, bool]:
    """(share of the item in the LCS, share of answer words, is a leak).

    No common subsequence is longer than the number of the item's words that occur in
    the region, so most candidates are settled without one (with that bound as share).
    """
    own = set(region)
    most = sum(map(own.__contains__, item.words)) / len(item.words)
    if most < 0.5:
        return most, 0.0, False
    answer = sum(map(own.__contains__, item.answer)) / len(item.answer)
    if most < least_lcs and answer < LEAST_ANSWER:
        return most, answer, False
    lcs = lcs_length(item.words, region) / len(item.words)
    return lcs, answer, lcs >= least_lcs or lcs >= 0.5 and answer >= LEAST_ANSWER


def search(texts: list[bytes], index: Index) -> Iterator[tuple[int, int, float, float, float, int, int]]:
    """(text, item, cosine, lcs, answer, first word, last word) of each leak; the best window of a pair."""
    ids, seg, split, base = _tokens(texts, index.vocab)
    upto = np.zeros((base[-1] + 1, index.project.shape[1]), np.float32)
    np.cumsum(_summed(index.project, ids, seg, int(base[-1])), axis=0, out=upto[1:])
    hits: dict[tuple[int, int], list] = {}
    for m in np.unique(index.segments):
        same = np.flatnonzero(index.segments == m)
        # a window that holds half an item reaches nearly half its length in its direction; no window reaches more than its own length
        least = LEAST_PART * index.length[same].min()
        for lo in range(0, int(base[-1]), WINDOWS):
            start = np.arange(lo, min(lo + WINDOWS, int(base[-1])))
            window = upto[np.minimum(start + m, base[-1])] - upto[start]
            norm = np.sqrt(np.einsum("ij,ij->i", window, window))
            some = np.flatnonzero(norm >= max(least, 1e-3))
            for which in (same[i : i + ITEMS] for i in range(0, len(same), ITEMS)):
                dot = window[some] @ index.latent[which].T
                a, b = np.nonzero((dot >= index.least_cosine * norm[some, None]) & (dot >= LEAST_PART * index.length[which]))
                cosine = dot[a, b] / norm[some[a]]
                at = start[some[a]]
                first = np.searchsorted(base, at, side="right") - 1
                last = np.searchsorted(base, np.minimum(at + m, base[-1]) - 1, side="right") - 1
                for d0, d1, k, c, s in zip(first.tolist(), last.tolist(), which[b].tolist(), cosine.tolist(), at.tolist()):
                    for doc in range(d0, d1 + 1):  # a window may run over short texts
                        hits.setdefault((doc, k), []).append((c, s, int(m)))
    for (doc, k), found in hits.items():
        item, best = index.items[k], None
        for cosine, s, m in sorted(found, reverse=True):
            lo = max(0, (s - int(base[doc])) * SEGMENT - len(item.words) // 2)
            hi = (s - int(base[doc]) + m) * SEGMENT + len(item.words) // 2
            lcs, answer, leak = verify(item, split[doc][lo:hi], index.least_lcs)
            if leak and (best is None or lcs > best[1]):
                best = cosine, lcs, answer, lo, min(hi, len(split[doc])) - 1
                if lcs == 1:
                    break
        if best:
            yield doc, k, *best


def find_leaks(docs: DataFrame, benchmark: DataFrame, index: Index | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, first_word, last_word): a row for each leaked item of each document row.

    Words count from 0. Null and empty texts have no leak, and null or empty items aren't
    found; rows that repeat a doc_id are searched each; ties between windows go to the higher
    cosine. Texts are searched whole, in windows, at any length. Without a document or an
    item the result is empty. Only doc_id, item_id and text are read, so other columns can't
    clash.
    """
    index = index or build(docs, benchmark)
    schema = "doc_id long, item_id long, cosine double, lcs double, answer double, first_word long, last_word long"
    if index is None:
        return docs.sparkSession.createDataFrame([], schema)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in slices(texts):
                rows = [(ids[lo + d], own.items[k].item_id, *rest) for d, k, *rest in search(texts[lo:hi], own)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return docs.where("text is not null").select("doc_id", utf8("text").alias("t")).mapInArrow(run, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, index: Index | None = None) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, with all their columns.

    Each row is judged by its own text, whatever its doc_id; null and empty texts stay,
    and so do all rows without a benchmark item. Repeated rows are judged each. Text
    isn't shuffled, and no column is added on the way, so none can clash.
    """
    index = index or build(docs, benchmark)
    if index is None:
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index
        for b in batches:
            texts = [(t or "").encode() for t in b.column(at).to_pylist()]
            keep = np.ones(len(texts), bool)
            for lo, hi in slices(texts):
                keep[[lo + d for d, *_ in search(texts[lo:hi], own)]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
