"""SimHash near-duplicates over a Gray-ordered hierarchical index.

Two fingerprints that differ in at most three bits agree in one of four 16-bit
segments, so each distinct fingerprint is dealt to four buckets and every link
shows up in one of them. A bucket with too many rows is dealt again, by four segments
of the bits that are left, and so on. Inside a bucket the fingerprints are sorted by Gray rank;
neighbours in that order share most bits, so a node of the index factors the bits
that all below it share into one masked pattern. A search adds up a query's
differences from the patterns on the way down and drops a whole group as soon as
the sum passes the radius. A bucket only passes on a star per linked group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import among, bit_of, checkpointed, row_key, saved, utf8
from .components import connected_components, joined

SEED = 42
FAN = 8
PARTS = 4  # segments, one more than differing bits
DEPTH = 4  # how often a bucket is dealt again at most
SHINGLE, LEAST_SIMILARITY = 5, 0.8
WORD_PRINTS = 6  # SimHashes of a text's words by which near copies are looked for
BEFORE = 4  # hashes that a posting knows of those before it
POSTINGS = 4  # how often texts are posted at most, each time with more hashes that are too common last
COMMON_WORDS = 1 << 16  # words of 64 bits of the bitmap of such hashes, which the driver and each task hold
SKETCH = 8  # words of 64 bits at least by which pairs that can't be similar are dropped


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the values have each of the 64 bits set."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 255 * 256):
        part = h[at : at + 255 * 256]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        if full:
            total += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[full:].sum(axis=0, dtype=np.uint8)
    return total


def shingles(text: bytes, n: int) -> Iterator[bytes]:
    """Runs of n words, A-Z lower-cased; of fewer words the whole sequence; none without a word."""
    words = text.lower().split()
    return map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) >= n else iter([b" ".join(words)] if words else [])


def fingerprint(text: bytes, shingle: int = 3, repeats: bool = True) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, each as often as it occurs or once; 0 without a word."""
    runs = shingles(text, shingle)
    h = np.fromiter(map(xxhash.xxh64_intdigest, runs if repeats else set(runs), repeat(SEED)), np.uint64)
    if not len(h):
        return 0
    return int(np.packbits(2 * _bit_counts(h) > len(h), bitorder="little").view(np.uint64)[0])


def word_fingerprints(text: bytes, n: int = WORD_PRINTS) -> np.ndarray:
    """n unsigned 64-bit SimHashes of a text's distinct words, each by other hashes of them; all 0 without a word."""
    words = np.fromiter(map(xxhash.xxh64_intdigest, set(shingles(text, 1)), repeat(SEED)), np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(n if len(words) else 0):
        h = words + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        out[k] = np.packbits(2 * _bit_counts(h) > len(h), bitorder="little").view(np.uint64)[0]
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def _levels(group: np.ndarray, fp: np.ndarray) -> list[tuple]:
    """The index over rows sorted by (group, Gray rank), leaves first.

    A level is (first child, one past the last child, shared mask, pattern, first row).
    The last level has one node a group.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    rows = np.arange(len(fp))
    out = [(rows, rows + 1, np.full(len(fp), full), fp, rows)]
    g, ones, some, first = group, fp, fp, rows
    while True:
        new = np.r_[True, g[1:] != g[:-1]]
        starts = np.flatnonzero(new)
        if len(out) > 1 and len(starts) == len(g):
            return out
        place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
        cut = np.flatnonzero(place % FAN == 0)
        ones, some = np.bitwise_and.reduceat(ones, cut), np.bitwise_or.reduceat(some, cut)
        mask = ~(ones ^ some)
        first = first[cut]
        out.append((cut, np.r_[cut[1:], len(g)], mask, ones & mask, first))
        g = g[cut]


def _close_pairs(group: np.ndarray, fp: np.ndarray, radius: int, step: int = 2048) -> Iterator[tuple]:
    """Row pairs (later, earlier) of one group within the radius, a block of queries at a time."""
    levels = _levels(group, fp)
    root = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
    for at in range(0, len(fp), step):
        q = np.arange(at, min(at + step, len(fp)))
        node = root[q]
        _, _, mask, pattern, _ = levels[-1]
        acc = np.bitwise_count((fp[q] ^ pattern[node]) & mask[node]).astype(np.int16)
        for depth in range(len(levels) - 1, 0, -1):
            start, end, mask, _, _ = levels[depth]
            near = acc <= radius
            q, node, acc = q[near], node[near], acc[near]
            n = (end - start)[node]
            child = np.repeat(start[node] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else node
            q, acc, above = np.repeat(q, n), np.repeat(acc, n), np.repeat(mask[node], n)
            _, _, mask, pattern, first = levels[depth - 1]
            use = first[child] < q
            q, acc, above, node = q[use], acc[use], above[use], child[use]
            acc = acc + np.bitwise_count((fp[q] ^ pattern[node]) & mask[node] & ~above).astype(np.int16)
        near = acc <= radius
        yield q[near], node[near]


def stars(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root) that join what is linked inside each group."""
    order = np.lexsort((gray_rank(fp), group))
    group, fp = group[order], fp[order]
    root = np.arange(len(fp))
    for a, b in _close_pairs(group, fp, radius):
        root = joined(root, a, b)
    moved = root != np.arange(len(fp))
    return fp[moved], fp[root[moved]]


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def _star_batches(radius: int):
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, held = [], [], 0

        def flush(n: int):
            k, f = np.concatenate(keys), np.concatenate(fps)
            a, b = stars(k[:n], f[:n], radius)
            keys[:], fps[:] = [k[n:]], [f[n:]]
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            keys.append(batch.column(0).to_numpy(zero_copy_only=False))
            fps.append(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            held += len(keys[-1])
            if held >= 50_000 and len(keys[-1]):
                k = np.concatenate(keys)
                n = int(np.searchsorted(k, k[-1]))  # the last group may go on
                if n:
                    yield flush(n)
                    held = len(k) - n
        if held:
            yield flush(held)

    return edges


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for every row of docs; null or wordless text has fp 0."""
    return docs.select("doc_id", utf8("text").alias("t")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _dealt(rows: DataFrame, depth: int) -> DataFrame:
    """rows (fp, k, rest) with a row for each segment of the bits that are left: k names the segments so far, rest has the others."""
    bits = 64
    for _ in range(depth):
        bits -= -(-bits // PARTS)
    width, out = -(-bits // PARTS), []
    for i in range(PARTS):
        lo, hi = i * width, min((i + 1) * width, bits)
        own = F.shiftrightunsigned("rest", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        low = F.col("rest").bitwiseAND(F.lit((1 << lo) - 1).cast("long"))
        rest = low if hi == bits else low.bitwiseOR(F.shiftleft(F.shiftrightunsigned("rest", hi), lo))
        out.append(F.struct(F.xxhash64("k", F.lit(i), own).alias("k"), rest.alias("rest")))
    return rows.select("fp", F.explode(F.array(*out)).alias("x")).select("fp", "x.k", "x.rest")


def _spread(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """Buckets (fp, k) that no dealing makes smaller: cut into salted parts, each pair of which is searched by its own group."""
    parts = rows.groupBy("k").agg(F.ceil(F.count("*") / bucket_rows).cast("long").alias("c"))
    rows = rows.join(parts, "k").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("c")))
    rows = rows.select("k", "fp", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("with"))
    return rows.select(F.xxhash64("k", F.least("part", "with"), F.greatest("part", "with")).alias("g"), "fp")


def links(fps: DataFrame, radius: int = 3, bucket_rows: int = 512, kind: str | None = None) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within the radius; only those of one kind, a column, if there are several.

    A bucket over bucket_rows is dealt again: its rows differ in at most three of the
    bits that are left, so they agree in one of four segments of these. A row stands in
    at most 4**n buckets after n times, where random fingerprints are 2**16, 2**28,
    2**37 and 2**44 buckets.
    """
    if radius >= PARTS:
        raise ValueError(f"{PARTS} segments find up to {PARTS - 1} differing bits")
    own = F.col(kind).cast("long") if kind else F.lit(0).cast("long")
    rows = _dealt(fps.select("fp", own.alias("k")).distinct().select("fp", "k", F.col("fp").alias("rest")), 0)
    groups = None
    for depth in range(1, DEPTH + 1):
        big = checkpointed(rows.groupBy("k").count().where(F.col("count") > bucket_rows).select("k"))
        small = rows.join(big, "k", "left_anti").select(F.col("k").alias("g"), "fp")
        groups = small if groups is None else groups.unionByName(small)
        if big.isEmpty():
            break
        again = checkpointed(rows.join(big, "k", "left_semi").select("fp", "k", "rest"))
        if depth == DEPTH:
            groups = groups.unionByName(_spread(again, bucket_rows))
        else:
            rows = _dealt(again, depth)
    return groups.repartition("g").sortWithinPartitions("g").mapInArrow(_star_batches(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id of the documents that links reach, own
    included. Null text counts as empty; rows with equal texts share a fingerprint;
    rows with a null doc_id stay and take the id of their component (null if no
    member has one). Only doc_id and text are read, so other columns can't clash.
    """
    fps = checkpointed(fingerprints(docs))
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    comps = connected_components(links(fps, radius)).withColumnRenamed("node", "fp")
    named = reps.join(comps, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(ids, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def similarity(a: bytes, b: bytes) -> float:
    """Share of the distinct five-word shingles of two texts that both hold (1 for two texts without a word)."""
    x, y = set(shingles(a, SHINGLE)), set(shingles(b, SHINGLE))
    return len(x & y) / len(x | y) if x or y else 1.0


def shingle_hashes(text: bytes) -> np.ndarray:
    """The distinct five-word shingles of a text as unsigned 64-bit hashes, ascending; a single 0 without a word."""
    words = np.fromiter(map(xxhash.xxh64_intdigest, text.lower().split(), repeat(SEED)), np.uint64)
    n = min(len(words), SHINGLE)
    h = np.full(max(len(words) - SHINGLE + 1, 1), n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(h)]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = np.sort(h ^ (h >> np.uint64(29)))
    return h[np.r_[True, h[1:] != h[:-1]]]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Bits, at least as many as hashes, each the parity of the hashes that name it; their number is a power of two.

    Two sketches differ in no more bits than their sets differ in hashes.
    """
    words = max(SKETCH, 1 << (len(hashes) - 1 >> 6).bit_length())
    odd = np.bincount((hashes % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same hashes with fewer words."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def prefix(n: int) -> int:
    """How many of n hashes, the first in any order that all sets share, hold one of any set that is similar enough."""
    return n - math.ceil(LEAST_SIMILARITY * n - 1e-9) + 1


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps, n, sketches = [], [], []
        for t in b.column(2):  # one text at a time
            text = t.as_py()
            hashes = shingle_hashes(text)
            fps.append(word_fingerprints(text).view(np.int64))
            n.append(len(hashes))
            sketches.append(sketch(hashes).view(np.int64))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(fps, longs), pa.array(n, pa.int64()), pa.array(sketches, longs)], ["row", "id", "h", "fps", "n", "sketch"])


def _similar_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        near = [similarity(x.as_py(), y.as_py()) >= LEAST_SIMILARITY for x, y in zip(b.column(2), b.column(3))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))


def _verified(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of the edges (a, b), each once, whose texts are similar enough."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    nodes = checkpointed(edges.select(F.col("a").alias("h")).unionByName(edges.select(F.col("b").alias("h"))).distinct())
    bodies = docs.select(F.xxhash64(utf8("text")).alias("h"), utf8("text").alias("t"))
    # a semi-join would be pushed below among(), and all texts shuffled
    bodies = saved(among(bodies, "h", nodes).groupBy("h").agg(F.first("t").alias("t")).join(nodes, "h"))
    met = edges.join(bodies.withColumnsRenamed({"h": "a", "t": "x"}), "a").join(bodies.withColumnsRenamed({"h": "b", "t": "y"}), "b")
    return met.select("a", "b", "x", "y").mapInArrow(_similar_batches, "a long, b long")


def _by_fingerprint(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts (h, fps): one star for each linked group of a bucket."""
    each = texts.select("h", F.posexplode("fps").alias("kind", "fp"))
    reps = checkpointed(each.groupBy("fp").agg(F.min("h").alias("rep"), F.min("kind").alias("kind")))
    same = each.join(reps, "fp").where("h <> rep").select(F.col("h").alias("a"), F.col("rep").alias("b"))
    of = lambda x: reps.select(F.col("fp").alias(x), F.col("rep").alias("rep_" + x))
    near = links(reps, kind="kind").distinct().join(of("a"), "a").join(of("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    return same.unionByName(near)


def in_posting_order(hashes: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
    """Ascending hashes as they stand, but for those last that `common`, a bitmap, names (and some others, as bits are shared)."""
    if common is None:
        return hashes
    word = (hashes.view(np.int64) >> 6) & (len(common) - 1)
    late = (common[word] >> (hashes & np.uint64(63)) & np.uint64(1)).astype(bool)
    return np.r_[hashes[~late], hashes[late]]


def _posting_batches(common: np.ndarray | None = None):
    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, size = [], []
            for t in b.column(1):
                hashes = in_posting_order(shingle_hashes(t.as_py()), common)
                own.append(hashes[: prefix(len(hashes))])
                size.append(len(own[-1]))
            if own:
                size = np.array(size)
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                h = np.repeat(b.column(0).to_numpy(zero_copy_only=False), size)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(h), pa.array(place.astype(np.int32))], ["w", "h", "i"])

    return posted


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (w, h, i), sorted by w and h, of the w that stand with two h or more, each once; no group is held."""
    last = None  # w and h of the last row
    only = np.zeros((0, 3), np.int64)  # the first row of a group that goes on, while it has one h
    shared = None
    for b in batches:
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)
        if not len(x):
            continue
        new = np.r_[last is None or tuple(x[0, :2]) != last, (x[1:, :2] != x[:-1, :2]).any(axis=1)]
        last = tuple(x[-1, :2])
        x = np.concatenate([only, x[new]])
        if not len(x):
            continue
        w, h = x[:, 0], x[:, 1]
        at = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        several = np.minimum.reduceat(h, at) != np.maximum.reduceat(h, at)
        several[0] |= shared is not None and w[0] == shared
        shared = w[-1] if several[-1] else None
        only = x[:0] if several[-1] else x[at[-1] : at[-1] + 1]
        out = x[np.repeat(several, np.diff(np.r_[at, len(w)]))]
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 2].astype(np.int32))], ["w", "h", "i"])


def _fits(i: np.ndarray, j: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m hashes can be similar enough if the first they share is at i in one and at j in the other."""
    least = np.ceil(LEAST_SIMILARITY / (1 + LEAST_SIMILARITY) * (n + m) - 1e-9)
    return (i + least <= n) & (j + least <= m)


def _alike(n, m, bits):
    """Whether sets of n and m hashes can be similar enough if their sketches differ in so many bits; they differ in |n - m| hashes at least."""
    return np.maximum(bits, abs(n - m)) * (1 + LEAST_SIMILARITY) <= (1 - LEAST_SIMILARITY) * (n + m) + 1e-6


def _met(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of hashes have one in common; 0 is none."""
    return ((x[:, :, None] == y[:, None, :]) & (x != 0)[:, :, None]).any(axis=(1, 2))


def cross_pairs(g: np.ndarray, h: np.ndarray, i: np.ndarray, n: np.ndarray, own: np.ndarray, sketches: np.ndarray | None = None, before: np.ndarray | None = None, step: int = 1 << 20) -> Iterator[tuple]:
    """Pairs (h, h) of the rows of one g, sorted by it, of different classes `own` that can be similar enough.

    before: hashes at which a row stands in groups too and which precede its own; rows
    that have one in common are left to the first group in which they meet.
    """
    size = np.diff(np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)])
    last = np.repeat(np.cumsum(size), size)  # one past each row's group
    found, held = [], 0
    rows, by = np.arange(len(g)), 1
    while len(rows := rows[rows + by < last[rows]]):
        a, b = rows, rows + by
        near = (own[a] != own[b]) & _fits(i[a], i[b], n[a], n[b])
        a, b = a[near], b[near]
        if sketches is not None:
            near = _alike(n[a], n[b], np.bitwise_count(sketches[a] ^ sketches[b]).sum(axis=1, dtype=np.int64))
            a, b = a[near], b[near]
        if before is not None:
            near = ~_met(before[a], before[b])
            a, b = a[near], b[near]
        if len(a):
            found.append((h[a], h[b]))
            held += len(a)
        if held >= step:
            yield tuple(np.concatenate(x) for x in zip(*found))
            found, held = [], 0
        by += 1
    if found:
        yield tuple(np.concatenate(x) for x in zip(*found))


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) from rows (g, h, i, n, own and, if they are there, sketch and before) sorted by g; only whole groups are searched."""
    kept: list[list] = []

    def flush(n: int) -> Iterator[pa.RecordBatch]:
        x = [np.concatenate(c) for c in zip(*kept)]
        kept[:] = [[c[n:] for c in x]]
        # a text that is dealt to a group twice is compared once
        order = np.lexsort((x[1][:n], x[0][:n]))
        g, h = x[0][order], x[1][order]
        order = order[np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])]]
        for a, b in cross_pairs(*(c[order] for c in x)):
            both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    held = 0
    for b in batches:
        if not b.num_rows:
            continue
        kept.append([c.to_numpy(zero_copy_only=False) for c in b.columns[:5]])
        if b.num_columns > 5:
            kept[-1] += [np.array([folded(x.values.to_numpy().view(np.uint64), SKETCH) for x in b.column(5)]), b.column(6).flatten().to_numpy().reshape(-1, BEFORE)]
        held += b.num_rows
        if held >= 50_000:
            g = np.concatenate([x[0] for x in kept])
            n = int(np.flatnonzero(g == g[-1])[0])  # the last group may go on
            if n:
                yield from flush(n)
                held = len(g) - n
    if held:
        yield from flush(held)


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("g").sortWithinPartitions("g")


def _alike_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        apart = []
        for x, y in zip(b.column(4), b.column(5)):
            x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
            k = min(len(x), len(y))
            apart.append(int(np.bitwise_count(folded(x, k) ^ folded(y, k)).sum()))
        near = _alike(b.column(2).to_numpy(), b.column(3).to_numpy(), np.array(apart, np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(near))


def _can_be_alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches don't differ in too many bits."""
    of = lambda x: texts.select(F.col("h").alias(x), F.col("n").alias("n_" + x), F.col("sketch").alias("s_" + x))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return both.mapInArrow(_alike_batches, "a long, b long")


def _posted(bodies: DataFrame, known: DataFrame, common: np.ndarray | None = None) -> DataFrame:
    """(w, h, i, n, own, c): the posts of bodies (h, t) under hashes where texts of several classes meet, with their number c."""
    posts = bodies.mapInArrow(_posting_batches(common), "w long, h long, i int")
    shared = posts.repartition("w").sortWithinPartitions("w", "h").mapInArrow(_shared_batches, "w long, h long, i int")
    rows = saved(shared.join(known, "h"))
    groups = rows.groupBy("w").agg(F.count("*").alias("c"), F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("w", "c")
    return saved(rows.join(groups, "w"))


def _bitmap(hashes: DataFrame, column: str, known: np.ndarray | None = None, words: int = COMMON_WORDS) -> np.ndarray:
    """A bitmap of so many words, a power of two, that names all hashes of a column, and those known."""
    bits = hashes.groupBy(F.pmod(F.shiftright(column, 6), F.lit(words)).alias("word")).agg(F.bit_or(bit_of(F.col(column))).alias("bits")).toArrow()
    out = np.zeros(words, np.uint64) if known is None else known.copy()
    out[bits["word"].to_numpy()] |= bits["bits"].to_numpy().view(np.uint64)
    return out


def _dealt_pairs(hot: DataFrame, texts: DataFrame, group_rows: int) -> DataFrame:
    """Pairs (a, b) of posts in groups of more than group_rows, which are dealt out, each pair of parts to a group of its own.

    Sketches drop pairs, and a pair is left to the first of its groups if the hashes just
    before tell of one. Rows grow with the square of a group.
    """
    fold = F.transform(F.sequence(F.lit(0), F.lit(SKETCH - 1)), lambda k: F.aggregate(F.filter("sketch", lambda _, j: F.pmod(j, F.lit(SKETCH)) == k), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)))
    hot = hot.join(texts.select("h", "sketch"), "h").withColumn("sketch", fold).withColumn("parts", F.ceil(F.col("c") / group_rows).cast("long"))
    earlier = Window.partitionBy("h").orderBy("i")
    hot = hot.withColumn("before", F.array(*(F.coalesce(F.lag("w", k).over(earlier), F.lit(0).cast("long")) for k in range(1, BEFORE + 1))))
    hot = hot.withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    hot = hot.select(F.xxhash64("w", F.least("part", "with"), F.greatest("part", "with")).alias("g"), "h", "i", "n", "own", "sketch", "before")
    return _in_order(hot).mapInArrow(_pair_batches, "a long, b long")


def _by_shingle(docs: DataFrame, texts: DataFrame, classes: DataFrame, group_rows: int = 256, star_rows: int = 16) -> DataFrame:
    """Verified links (a, b) that join all texts which are similar enough and not of one class (node, component) yet.

    A text is posted under the least of its shingles' hashes, as many as hold one of any
    similar set (prefix filter), and meets the others there. Where more than star_rows
    meet, they are compared with one of them first, another at each hash, so that near
    copies are of one class before all pairs of different classes are searched. Where
    more than group_rows meet, and comparing them would take more rows than there are texts,
    they are posted anew, among themselves, in an order that has those common hashes
    last: similar texts of them meet under rarer ones. The prefix filter holds in any order,
    so no pair is left out. What still meets in large groups after POSTINGS times, as texts
    that share most of their shingles, is dealt out and compared by sketches.
    """
    bodies = docs.select(F.xxhash64(utf8("text")).alias("h"), utf8("text").alias("t"))
    known = texts.select("h", "n").join(classes.withColumnRenamed("node", "h"), "h", "left").select("h", "n", F.coalesce("component", "h").alias("own"))
    rows = _posted(bodies, known)
    many = rows.where(F.col("c") > star_rows)
    centres = many.groupBy("w").agg(F.min_by(F.struct("h", "own"), F.xxhash64("h", "w")).alias("x")).select("w", F.col("x.h").alias("b"), F.col("x.own").alias("to"))
    star = many.join(centres, "w").where("own <> to").select(F.greatest("h", "b").alias("a"), F.least("h", "b").alias("b")).distinct()
    found = saved(_verified(docs, _can_be_alike(star, texts)))
    ends = lambda x: known.select(F.col("h").alias(x), F.col("own").alias("own_" + x))
    joined = connected_components(found.join(ends("a"), "a").join(ends("b"), "b").select(F.col("own_a").alias("a"), F.col("own_b").alias("b")))
    renamed = lambda x: x.join(joined.withColumnRenamed("node", "own"), "own", "left").withColumn("own", F.coalesce("component", "own")).drop("component")
    rows, known = saved(renamed(rows)), renamed(known)
    bound, pairs, common = texts.count(), None, None
    for time in range(1, POSTINGS + 1):
        few = rows.where(F.col("c") <= group_rows).select(F.col("w").alias("g"), "h", "i", "n", "own")
        near = _in_order(few).mapInArrow(_pair_batches, "a long, b long")
        pairs = near if pairs is None else pairs.unionByName(near)
        hot = rows.where(F.col("c") > group_rows)
        apart = checkpointed(hot.groupBy("w").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.first("c").alias("c")).where("lo <> hi").select("w", "c"))
        dealt = apart.agg(F.sum(F.col("c") * F.ceil(F.col("c") / group_rows))).first()[0] or 0
        hot = hot.join(apart.select("w"), "w")
        if dealt <= bound or time == POSTINGS:
            pairs = pairs.unionByName(_dealt_pairs(hot, texts, group_rows)) if dealt else pairs
            break
        common = _bitmap(apart, "w", common)
        rows = _posted(among(bodies, "h", checkpointed(hot.select("h").distinct())), known, common)
    return found.unionByName(_verified(docs, _can_be_alike(pairs.distinct(), texts)))


def similar_texts(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (a, b) that join all distinct texts which are similar enough, from texts (h, fps, n, sketch).

    Most are found by fingerprints, the others by the prefix filter, which leaves out
    none (but for equal 64-bit hashes of different shingles).
    """
    classes = connected_components(_verified(docs, _by_fingerprint(texts)))
    return classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_by_shingle(docs, texts, classes))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs but for copies and near copies of an earlier one, with all their columns.

    Near copies have LEAST_SIMILARITY of their distinct five-word shingles in common.
    They are looked for by WORD_PRINTS SimHashes of their distinct words, which changes of
    single words move least, within three bits of any, then by shared shingles, which miss
    none; whatever goes is equal to, or linked by verified pairs with, the row that stays,
    and no two rows that stay are near copies. That is the first by doc_id,
    null last, then by a hash of doc_id and text. Rows that are equal in doc_id and text
    are copies of each other. Null text counts as empty; empty texts are copies. An
    empty table gives an empty one.
    """
    key = row_key("doc_id", "text")
    rows = docs.select(key.alias("row"), F.col("doc_id").alias("id"), utf8("text").alias("t"), F.xxhash64(utf8("text")).alias("h"))
    rows = checkpointed(rows.mapInArrow(_word_batches, "row long, id long, h long, fps array<long>, n long, sketch array<long>"))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    texts = checkpointed(rows.groupBy("h").agg(F.first("fps").alias("fps"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(place).alias("place")))
    comps = connected_components(similar_texts(docs, texts)).withColumnRenamed("node", "h")
    classes = texts.select("h", "place").join(comps, "h", "left").groupBy(F.coalesce("component", "h").alias("class")).agg(F.min("place").alias("place"))
    stays = classes.select(F.col("place.row").alias("row"), F.lit(True).alias("stays"))
    keys = rows.groupBy("row").count().join(stays, "row", "left")
    # rows that go, and rows of which one stays; all others aren't shuffled
    special = checkpointed(keys.where("stays is null or count > 1").select("row", F.coalesce("stays", F.lit(False)).alias("stays")))
    full = docs.select(key.alias("row"), F.struct("*").alias("doc"))
    hit = among(full, "row", special, certain=False)
    there = hit.where("hit").join(special, "row", "left")
    once = there.where("stays").groupBy("row").agg(F.first("doc").alias("doc")).select("doc")
    left = hit.where("not hit").select("doc").unionByName(there.where("stays is null").select("doc")).unionByName(once)
    return left.select(*(F.col("doc")[c].alias(c) for c in docs.columns))
