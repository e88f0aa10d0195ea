"""Quality rules: text statistics, and a hashed n-gram log-likelihood ratio. DataFrame operations only.

Words and word pairs fall into BUCKETS hash buckets. Two multinomials over these, one of
trusted documents and one of the whole corpus, give each document the mean log ratio of
its n-grams; a document is kept if that is not below what nearly all trusted ones have,
and if no passage of it holds more of the toxic label's words than nearly all of theirs.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import let, with_computed
from . import toxic
from .common import binned_quantile, checkpointed

BUCKETS = 8192
_BIN = 0.01


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _features(hashes: str) -> Column:
    """Buckets of each word and of each pair of words, from the words' hashes."""
    single = F.transform(hashes, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    pair = F.zip_with(hashes, F.slice(F.col(hashes), 2, F.greatest(F.size(hashes), F.lit(1))), lambda x, y: F.when(y.isNotNull(), F.pmod(F.xxhash64(x, y), F.lit(BUCKETS)).cast("int")))
    return F.array_compact(F.concat(single, pair))


def _hashed(docs: DataFrame, *keep: str) -> DataFrame:
    words = docs.select(*keep, _words(F.coalesce("text", F.lit(""))).alias("w"))
    return words.select(*keep, F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))


def _bucket_counts(docs: DataFrame, name: str) -> DataFrame:
    return _hashed(docs).select(F.explode(_features("wh")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def trusted(labels: DataFrame) -> DataFrame:
    """(doc_id) of the documents that are labelled as good and not as toxic."""
    best = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return best.where("q = 1 and t = 0 and doc_id is not null").select("doc_id")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> list[float] | None:
    """Log ratio of each bucket (add-one smoothing); None without trusted text.

    The raw counts cover all documents. The target is fitted on the whole texts of at
    most `sample` trusted documents, those of smallest hashed doc_id, whose ids are
    broadcast (that many numbers); so no text is shuffled. The driver gets BUCKETS
    numbers.
    """
    chosen = trusted(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    target = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    raw = {r["bucket"]: r["n"] for r in _bucket_counts(docs.select("text"), "n").collect()}
    good = {r["bucket"]: r["n"] for r in _bucket_counts(target.select("text"), "n").collect()}
    if not good:
        return None
    a, b = sum(good.values()) + BUCKETS, sum(raw.values()) + BUCKETS
    return [math.log((good.get(k, 0) + 1) / a) - math.log((raw.get(k, 0) + 1) / b) for k in range(BUCKETS)]


def _repeated() -> Column:
    """Places, in order, of the three-word windows of w that stand in the text twice or more.

    Where all hashes of the windows' words' hashes differ, as in most texts, there are
    none. Else windows are sorted by that hash, so that equal ones are neighbours; of
    neighbours with equal hashes the words are compared.
    """
    def window(i: Column) -> Column:
        return F.xxhash64(F.get("wh", i), F.get("wh", i + 1), F.get("wh", i + 2))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & reduce(and_, (F.get("w", x["i"] + k) == F.get("w", y["i"] + k) for k in range(3))), F.lit(False))

    def places(hashes: Column) -> Column:
        windows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(windows, lambda own: F.filter(own, lambda x, k: same(x, F.get(own, k - 1)) | same(x, F.get(own, k + 1))))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    none = F.array().cast("array<int>")
    hashes = F.when(F.col("n") >= 3, F.transform(F.sequence(F.lit(0), F.col("n") - 3), window)).otherwise(F.array().cast("array<bigint>"))
    return let(hashes, lambda own: F.when(F.size(F.array_distinct(own)) == F.size(own), none).otherwise(places(own)))


def statistics(docs: DataFrame, ratios: list[float] | None, *keep: str, weights: dict[str, float] | None = None) -> DataFrame:
    """The columns `keep` of docs, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, toxic_score and llr.

    llr is the mean log ratio of a text's words and word pairs (0 without a word),
    toxic_score the worst passage by the weights of toxic.lexicon().
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(*keep, text.alias("t"), _words(text).alias("w"), lines.alias("ls"))
    rows = rows.select(
        *keep,
        "w",
        F.size("w").alias("n"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        toxic.passage_column(docs, F.col("t"), weights or {}).alias("toxic_score"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("wh"),
    )
    base = [*keep, "n", "word_chars", "n_symbols", "n_dup_lines", "toxic_score"]
    if ratios is None:
        llr = F.lit(0.0)
    else:
        table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
        sums = F.aggregate(_features("wh"), F.lit(0.0), lambda s, k: s + F.get(table, k))
        llr = F.when(F.col("n") > 0, sums / (2 * F.col("n") - 1)).otherwise(0.0)
    rows = with_computed(rows, {"p": _repeated(), "llr": llr}).drop("w", "wh")
    three = F.lit(3)
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(three, F.coalesce(F.get("p", i + 1) - x, three)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select(*keep, F.col("n").cast("long").alias("n_words"), *base[len(keep) + 1 : -1], covered.alias("n_repeat_words"), "toxic_score", "llr")


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.005, slack: float = 0.05) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept) for every row of docs.

    kept: not base_failed, and llr at least the `quantile` of the trusted documents'
    llr less `slack`, in steps of a hundredth, and no passage with more of the toxic
    label's words than all but the share `quantile` of the trusted documents have. Null
    text has no word; without trusted text only the base rules decide; a null doc_id is
    never trusted. Repeated rows give a row each, by their own text, at any length; an empty
    table gives an empty one; only doc_id and text are read, so other columns can't clash.
    """
    ratios = fit(docs, labels)
    weights = toxic.lexicon(toxic.labelled_texts(docs, labels)) if ratios is not None else {}
    rows = checkpointed(statistics(docs, ratios, "doc_id", weights=weights))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    limit = None
    if ratios is not None:
        scored = rows.where("n_words > 0 and not base_failed").join(trusted(labels), "doc_id", "left_semi")
        bins = scored.groupBy(F.floor(F.col("llr") / _BIN).alias("bin")).count().collect()
        limit = binned_quantile([(r["bin"] * _BIN, r["count"]) for r in bins], quantile)
    good = F.lit(True) if limit is None else F.col("llr") >= limit - slack
    if weights:
        good = good & (F.col("toxic_score") <= toxic.limit(rows, trusted(labels), 1 - quantile))
    return rows.withColumn("kept", ~F.col("base_failed") & good).drop("toxic_score")
