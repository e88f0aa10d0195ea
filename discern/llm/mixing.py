"""Mixing sources to target weights, by blocks and pseudorandom index permutations.

The words of a source, in a fixed order of its documents, are one stream that is cut
into blocks of equal length. A source's target is a number of slots, each slot being
one block (or, for the very last slot, part of one). Multinomial draws deal the slots
of all sources to groups of output shards, and those of each group to its shards. Slot k of a source is slot k mod n of pass k div n
over its n blocks, and a keyed permutation of 0..n-1, another for each pass, names the
block; blocks and slots are then joined by index. Nothing is shuffled at random.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checkpointed

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK_WORDS = 256
SHARD_SLOTS = 1 << 14
SHARDS = 1 << 10  # of a group
MOST_SOURCES = 100_000
BUCKETS = 1 << 12  # whose words are summed up at a time


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int  # words
    target: float
    full: int  # blocks of full length
    tail: int  # words of the last, shorter block; 0: there is none
    passes: int  # over all blocks
    rest: int  # words of a last, partial pass

    @property
    def blocks(self) -> int:
        return self.full + (self.tail > 0)

    def slots(self, block: int) -> int:
        part = min(self.full, -(-self.rest // block)) + (self.rest > self.full * block)
        return self.passes * self.blocks + (part if self.rest else 0)


def targets(sizes: dict[str | None, int], weights: tuple = WEIGHTS, most: int = MOST_PASSES) -> dict[str | None, float]:
    """Target words of each source.

    Sources by code point, null last, weigh weights[0], weights[1], ... repeating and
    share the sum of all sizes; a target stops at `most` times its source's size, and
    the excess is shared by weight among the others until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, free = sum(sizes.values()), list(order)
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in free}
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of each i under the permutation of 0..n-1 that its key names (a Feistel cipher that walks cycles)."""
    half = (np.maximum(np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64), 1) + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = i.astype(np.uint64), np.arange(len(i))
    while len(todo):
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for r in range(4):
            h = (right + key[todo] + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask[todo])
        x[todo] = (left << half[todo]) | right
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


def draws(slots: list[int], shard_slots: int, seed: int) -> Iterator[tuple[int, int, int, int]]:
    """(shard, source index, first slot, number): multinomial counts of each shard.

    A shard's counts are drawn with the sources' remaining slots as probabilities and
    stop at what remains, so that all slots are dealt out.
    """
    rng = np.random.default_rng(seed)
    left = np.array(slots, np.int64)
    at = np.zeros_like(left)
    shard = 0
    while left.sum():
        want = min(shard_slots, int(left.sum()))
        got = np.zeros_like(left)
        while (short := want - int(got.sum())) > 0:
            free = left - got
            got += np.minimum(rng.multinomial(short, free / free.sum()), free)
        for s in np.flatnonzero(got):
            yield shard, int(s), int(at[s]), int(got[s])
        left, at, shard = left - got, at + got, shard + 1


def _shard_batches(shard_slots: int, seed: int):
    """Deals the slots of each group of shards to the shards."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                own = draws(row["n"], shard_slots, seed + 1 + row["group"])
                rows = [(row["group"] * SHARDS + shard, row["sid"][s], row["first"][s] + at, n) for shard, s, at, n in own]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["shard", "sid", "first", "n"])

    return dealt


def _slot_batches(sources: list[Source], block: int, seed: int):
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "sid", "slot", "block", "take"]
        for b in batches:
            for row in b.to_pylist():
                s = sources[row["sid"]]
                for lo in range(row["first"], row["first"] + row["n"], 1 << 18):
                    k = np.arange(lo, min(lo + (1 << 18), row["first"] + row["n"]))
                    turn, place = k // s.blocks, k % s.blocks
                    inner = place < s.full
                    key = np.full(len(k), (seed * 1_000_003 + row["sid"]) % (1 << 40), np.uint64) * np.uint64(64) + turn.astype(np.uint64) % np.uint64(64)
                    to = np.where(inner, permuted(np.where(inner, place, 0), np.full(len(k), max(s.full, 1)), key), s.full)
                    length = np.where(inner, block, s.tail)
                    take = np.where(turn < s.passes, length, np.minimum(length, s.rest - place * block))
                    full = np.full(len(k), row["sid"], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(k), row["shard"], np.int64), full, k, to.astype(np.int64), take.astype(np.int64))], names)

    return dealt


@dataclass
class Mix:
    """A plan: sources, the sized documents it was made from, and its slots.

    sized: doc_id, source, size, h (hash of the text); slots: shard, sid (index into
    sources), slot, block, take (words of the block).
    """

    spark: SparkSession
    sources: list[Source]
    sized: DataFrame
    slots: DataFrame
    block: int
    buckets: int

    def with_offsets(self, docs: DataFrame) -> DataFrame:
        """docs (with doc_id, source, size, h) and sid, bucket, rn and at, the row's first word in its source's stream.

        A source is dealt to hash buckets, each summed up on its own; the order is by
        bucket, then doc_id, size and text hash, so that it holds for any partitioning.
        """
        ids = self.spark.createDataFrame([(i, s.name) for i, s in enumerate(self.sources)], "sid long, name string")
        docs = docs.join(F.broadcast(ids), F.col("source").eqNullSafe(F.col("name"))).drop("name")
        docs = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(self.buckets)))
        sums = docs.groupBy("sid", "bucket").agg(F.sum("size").alias("words")).withColumn("range", F.floor(F.col("bucket") / BUCKETS))
        # the words in front of a bucket: of the ranges before its own, and of the buckets before it in its range
        before = lambda order, *by: F.coalesce(F.sum("words").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ranges = sums.groupBy("sid", "range").agg(F.sum("words").alias("words")).select("sid", "range", before("range", "sid").alias("start"))
        sums = sums.withColumn("inner", before("bucket", "sid", "range")).join(ranges, ["sid", "range"])
        sums = sums.select("sid", "bucket", (F.col("start") + F.col("inner")).alias("base"))
        inside = W.partitionBy("sid", "bucket").orderBy("doc_id", "size", "h")
        docs = docs.withColumns({"rn": F.row_number().over(inside), "local": F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")})
        return docs.join(sums, ["sid", "bucket"]).withColumn("at", F.col("base") + F.col("local")).drop("base", "local")

    def blocks_of(self) -> Column:
        """The blocks that a row's words fall into (an array; empty without words)."""
        last = F.floor((F.col("at") + F.col("size") - 1) / self.block)
        return F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / self.block), last)).otherwise(F.array().cast("array<bigint>"))


def plan(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> Mix:
    """The mix of docs (doc_id, source, text).

    The driver holds a row for each source (more than MOST_SOURCES is an error) and, for
    each group of SHARDS shards, one for each of its sources; tasks draw for the shards.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = checkpointed(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("h")))
    counted = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(counted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = {r["source"]: int(r["n"]) for r in counted}
    goal = targets(sizes)
    sources = []
    for name in sorted(sizes, key=lambda s: (s is None, s or "")):
        n, take = sizes[name], min(MOST_PASSES * sizes[name], round(goal[name]))
        sources.append(Source(name, n, goal[name], n // block_words, n % block_words, take // n if n else 0, take % n if n else 0))
    slots = [s.slots(block_words) for s in sources]
    groups: dict[int, list] = {}
    for group, *rest in draws(slots, shard_slots * SHARDS, seed):
        groups.setdefault(group, []).append(rest)
    rows = spark.createDataFrame([(g, *map(list, zip(*own))) for g, own in groups.items()], "group long, sid array<long>, first array<long>, n array<long>")
    shards = rows.repartition("group").mapInArrow(_shard_batches(shard_slots, seed), "shard long, sid long, first long, n long")
    dealt = shards.repartition("shard", "sid").mapInArrow(_slot_batches(sources, block_words, seed), "shard long, sid long, slot long, block long, take long")
    return Mix(spark, sources, sized, dealt, block_words, max(64, -(-sum(sizes.values()) // 1_000_000)))


def taken(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs.

    taken counts the words that the mix takes of a document, repeats counted. Null
    text has size 0; a null source is a source of its own; rows that repeat a doc_id
    are documents of their own; an empty table gives no row.
    """
    mix = mix or plan(docs)
    rows = mix.with_offsets(mix.sized)
    pieces = rows.select("*", F.explode_outer(mix.blocks_of()).alias("block"))
    lo, hi = F.greatest("at", F.col("block") * mix.block), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * mix.block)
    pieces = pieces.withColumns({"start": lo - F.col("block") * mix.block, "n": hi - lo})
    length = F.when(F.col("block") < F.col("full"), mix.block).otherwise(F.col("tail"))
    about = mix.spark.createDataFrame([(i, s.size, s.target, s.full, s.tail) for i, s in enumerate(mix.sources)], "sid long, source_size long, target double, full long, tail long")
    use = mix.slots.join(F.broadcast(about), "sid").groupBy("sid", "block").agg(
        F.sum((F.col("take") >= length).cast("long")).alias("whole"), F.sum(F.when(F.col("take") < length, F.col("take")).otherwise(0)).alias("part")
    )
    words = F.col("whole") * F.col("n") + F.greatest(F.lit(0), F.least(F.col("n"), F.col("part") - F.col("start")))
    got = pieces.join(use, ["sid", "block"], "left").groupBy("sid", "bucket", "rn", "doc_id", "size").agg(F.coalesce(F.sum(words), F.lit(0)).alias("taken"))
    return got.join(F.broadcast(about), "sid").select("doc_id", "size", "source_size", "target", "taken")


def _piece_batches(block: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sids, ids, at = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for sid, doc, a, text in zip(sids, ids, at, b.column(3).to_pylist()):
                words, i = text.split(), 0
                while i < len(words):
                    to, start = divmod(a + i, block)
                    n = min(block - start, len(words) - i)
                    for column, x in zip(out, (sid, to, start, doc, b" ".join(words[i : i + n]))):
                        column.append(x)
                    i += n
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["sid", "block", "start", "doc_id", "piece"])

    return cut


def mixed_blocks(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """(shard, slot, source, doc_ids, n_words, text): the mix itself, a row for each slot.

    doc_ids names the documents of the block in order; text is their words, space-joined.
    Null and wordless texts give nothing; a null source is a source of its own; rows
    that repeat a doc_id are documents of their own; only doc_id, source and text are
    read; an empty table gives no block.
    """
    mix = mix or plan(docs)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = mix.with_offsets(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("t")).where("size > 0"))
    pieces = rows.select("sid", "doc_id", "at", "t").mapInArrow(_piece_batches(mix.block), "sid long, block long, start long, doc_id long, piece binary")
    blocks = pieces.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("start", "doc_id", "piece"))).alias("p"))
    names = mix.spark.createDataFrame([(i, s.name) for i, s in enumerate(mix.sources)], "sid long, source string")
    text = F.concat_ws(" ", F.transform("p", lambda x: x["piece"].cast("string")))
    out = mix.slots.hint("merge").join(blocks, ["sid", "block"]).join(F.broadcast(names), "sid")
    out = out.select("shard", "slot", "source", F.col("p.doc_id").alias("doc_ids"), F.col("take").alias("n_words"), text.alias("text"), F.regexp_count(text, F.lit(WORD)).alias("len"))
    cut = F.when(F.col("n_words") < F.col("len"), F.array_join(F.slice(F.split("text", " "), 1, F.col("n_words").cast("int")), " ")).otherwise(F.col("text"))
    return out.withColumn("text", cut).drop("len")
