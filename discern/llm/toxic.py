"""Words that the toxic label goes with, and the worst passage of a text. DataFrame operations only.

A word's weight is its log ratio of toxic to other labelled documents. Toxic documents
in which the word has the same neighbours (of its places in a text, that with the least
hash of both) count once, so that copies of one document make no evidence. Words that chance could bring forward weigh nothing. A
text's score is the largest sum of weights in PASSAGE words in a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, binned_quantile, bit_of, checkpointed, saved

PASSAGE = 20
LEAST_DOCS = 5
#: A word's G statistic exceeds that of the best of as many chance words by SURE.
SURE = 10.0
_BIN = 0.01
_SEPARATORS = bytes(c if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: Column) -> Column:
    """Lower-cased words; ASCII punctuation separates them."""
    return F.array_remove(F.split(F.lower(text), r"[\x00-/:-@\[-`{-\x7F]+"), "")


def words_of(text: bytes) -> list[bytes]:
    """words(), in Python."""
    return text.decode().lower().encode().translate(_SEPARATORS).split()


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic) of each document with a label; good ones have quality 1 and aren't toxic."""
    best = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return best.select("doc_id", F.expr("coalesce(q = 1 and t = 0, false)").alias("good"), F.expr("coalesce(t = 1, false)").alias("toxic"))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, good, toxic) of the labelled documents, kept in the shared folder; only they are shuffled."""
    known = labelled(labels)
    ids = known.select(F.xxhash64("doc_id").alias("id"))
    own = among(docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("id")), "id", ids)
    # the ids grow with the corpus, so this is a shuffled join whatever their number
    return saved(own.drop("id").join(known.hint("merge"), "doc_id"))


def lexicon(texts: DataFrame) -> dict[str, float]:
    """Weight of each word that goes with the toxic label; texts: labelled_texts().

    All labelled documents are counted. The driver gets the words found only.
    """
    totals = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count_distinct("doc_id").alias("n")).collect()}
    n_toxic, n_other = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic or not n_other:
        return {}
    split = texts.select("doc_id", "toxic", words(F.col("text")).alias("w"))
    context = lambda x, i: F.struct(x.alias("v"), F.xxhash64(F.get("w", i - 1), F.get("w", i + 1)).alias("c"))
    pairs = split.where("toxic").select("doc_id", F.explode(F.transform("w", context)).alias("x")).select("doc_id", "x.v", "x.c")
    first = pairs.groupBy("doc_id", "v").agg(F.min("c").alias("c"))
    found = first.select("v", "c").distinct().groupBy("v").agg(F.count("*").alias("a"))
    found = checkpointed(found.where(F.col("a") >= LEAST_DOCS).select("v", F.xxhash64("v").alias("h"), "a"))
    many = found.count()
    if not many:
        return {}
    other = split.where("not toxic").select(F.explode(F.array_distinct(F.transform("w", lambda x: F.xxhash64(x)))).alias("h"))
    counts = found.join(among(other, "h", found.select("h")).groupBy("h").agg(F.count("*").alias("b")), "h", "left").select("v", "a", F.coalesce("b", F.lit(0)).alias("b"))
    share = F.lit(n_toxic / (n_toxic + n_other))
    both = F.col("a") + F.col("b")
    g = 2 * (F.col("a") * F.ln(F.col("a") / (both * share)) + F.when(F.col("b") > 0, F.col("b") * F.ln(F.col("b") / (both * (1 - share)))).otherwise(0.0))
    rows = counts.where(F.col("a") > both * share).where(g > SURE + 2 * math.log(many)).collect()
    return {r["v"]: math.log((r["a"] + 0.5) / (n_toxic + 1)) - math.log((r["b"] + 0.5) / (n_other + 1)) for r in sorted(rows, key=lambda r: r["v"])}


def passage_score(ws: list[bytes], weights: dict[bytes, float]) -> float:
    """The largest sum of weights in PASSAGE words in a row."""
    at = [(i, weights[w]) for i, w in enumerate(ws) if w in weights]
    best = run = 0.0
    lo = 0
    for i, x in at:
        run += x
        while at[lo][0] <= i - PASSAGE:
            run -= at[lo][1]
            lo += 1
        best = max(best, run)
    return best


def passage_column(docs: DataFrame, text: Column, weights: dict[str, float]) -> Column:
    """passage_score() of a text as a column."""
    if not weights:
        return F.lit(0.0)
    hashes = docs.sparkSession.range(1).select(*(F.xxhash64(F.lit(w)).alias(f"h{k}") for k, w in enumerate(weights))).first()
    bits = [0] * 1024
    for h in hashes:
        bits[(h >> 6) % 1024] |= 1 << (h & 63)
    bits = [x - (1 << 64) if x >> 63 else x for x in bits]
    table = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")
    value = F.create_map(*(F.lit(x) for h, v in zip(hashes, weights.values()) for x in (h, v)))
    near = lambda h: F.get(table, F.pmod(F.call_function("shiftright", h, F.lit(6)), F.lit(1024)).cast("int")).bitwiseAND(bit_of(h)) != 0
    hit = F.array_compact(F.transform(F.transform(words(text), lambda x: F.xxhash64(x)), lambda h, i: F.when(near(h), F.struct(i.alias("i"), h.alias("h")))))
    hit = F.transform(hit, lambda x: F.struct(x["i"].alias("i"), F.coalesce(F.try_element_at(value, x["h"]), F.lit(0.0)).alias("v")))
    # no more than PASSAGE hits stand in PASSAGE words
    sums = lambda own: F.transform(own, lambda x, k: F.aggregate(F.slice(own, k + 1, F.lit(PASSAGE)), F.lit(0.0), lambda s, y: s + F.when(y["i"] < x["i"] + PASSAGE, y["v"]).otherwise(0.0)))
    return F.coalesce(F.array_max(F.flatten(F.transform(F.array(hit), sums))), F.lit(0.0))


def limit(scores: DataFrame, good: DataFrame, quantile: float) -> float:
    """The score that the share `quantile` of the good documents doesn't exceed; scores: doc_id, toxic_score."""
    known = scores.select("doc_id", "toxic_score").join(good, "doc_id", "left_semi")
    bins = known.groupBy(F.ceil(F.col("toxic_score") / _BIN).alias("bin")).count().collect()
    return (binned_quantile([(r["bin"] * _BIN, r["count"]) for r in bins], quantile) or 0.0) + 1e-9
