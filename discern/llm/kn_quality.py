"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is over characters and of order four. A gram is a number of four UTF-16 units,
so its history and its suffix are shifts and masks of it. Grams of all trusted text are
counted; for every gram that any document holds, joins by gram, history and suffix with
the counts of all orders give its probability. A document's perplexity is the mean over
its grams, held against a quantile of its language's trusted documents. Characters alone
don't tell an insult from other prose, so words that go with the toxic label are counted
too, and a document's worst passage of them is held against a limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import toxic
from .common import binned_quantile, checkpointed, row_key, saved, slices, utf8

ORDER = 4
UNIT = 16  # bits
#: Grams whose probabilities are broadcast at most (12 bytes each); beyond that documents are joined with them.
MOST_BROADCAST = 4_000_000
#: Trusted documents that a language needs for a threshold of its own.
LEAST_TRUSTED = 20
#: How far the threshold is raised for a short text.
SHORT = 1.5
_BIN = 0.01
_BLANK, _DIGIT = 32, ord("0")


def units(text: bytes) -> np.ndarray:
    """UTF-16 units of a lower-cased text behind ORDER - 1 blanks; a run of blanks counts as one, and digits are alike."""
    c = np.frombuffer(text.decode().lower().encode("utf-16-le", "surrogatepass"), "<u2")
    c = np.where(c <= 32, _BLANK, np.where((c >= 48) & (c <= 57), _DIGIT, c)).astype(np.uint64)
    if len(c) > 1:
        c = c[np.r_[True, (c[1:] != _BLANK) | (c[:-1] != _BLANK)]]
    return np.r_[np.full(ORDER - 1, _BLANK, np.uint64), c]


def keys(text: bytes) -> np.ndarray:
    """The gram that ends at each character."""
    c = units(text)
    out = np.zeros(len(c) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        out = out << np.uint64(UNIT) | c[k : len(c) - ORDER + 1 + k]
    return out.view(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(0).to_pylist()
        for lo, hi in slices(texts):
            g, n = np.unique(np.concatenate([keys(t) for t in texts[lo:hi]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int64))], ["g", "c"])


def gram_counts(texts: DataFrame) -> DataFrame:
    """(g, c) of a column t of bytes."""
    return texts.select("t").mapInArrow(_count_batches, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _suffix(g: str, order: int) -> Column:
    return F.col(g).bitwiseAND(F.lit((1 << UNIT * order) - 1))


def _history(g: str) -> Column:
    return F.shiftrightunsigned(g, UNIT)


def _discounts(n: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and above, from the numbers of grams that occur once to four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return [min(float(k), max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 for k in (1, 2, 3)]


def probabilities(counts: DataFrame, grams: DataFrame) -> DataFrame:
    """(g, logp) of each of the distinct grams (a column g), from counts (g, c) of the trusted text.

    The highest order has counts, the others numbers of distinct grams that end in them.
    All joins are by gram, history or suffix. The driver gets a row of sums an order.
    """
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = checkpointed(orders[k + 1].groupBy(_suffix("g", k).alias("g")).agg(F.count("*").alias("c")))
    of = lambda *at: [F.count_if(F.col("c") == k) for k in at]
    seen = {k: tuple(t.agg(*of(1, 2, 3, 4), F.count("*"), F.sum("c")).first()) for k, t in orders.items()}
    wanted = {ORDER: grams.select("g")}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = checkpointed(wanted[k + 1].select(_suffix("g", k).alias("g")).distinct())
    below = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(list(seen[k][:4]))
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).when(F.col("c") > 2, d3).otherwise(0.0)
        sums = (F.sum("c").cast("double").alias("total"), F.sum(off).alias("back"))
        rows = wanted[k].join(orders[k].select("g", F.col("c").cast("double").alias("own"), off.alias("off")), "g", "left")
        if k == 1:
            total, back = orders[1].agg(*sums).first()
            rows = rows.withColumns({"total": F.lit(total), "back": F.lit(back), "low": F.lit(1.0 / (seen[1][4] + 1))})
        else:
            histories = orders[k].groupBy(_history("g").alias("history")).agg(*sums)
            rows = rows.withColumns({"history": _history("g"), "suffix": _suffix("g", k - 1)})
            rows = rows.join(histories, "history", "left").join(below.withColumnsRenamed({"g": "suffix", "p": "low"}), "suffix")
        p = F.when(F.col("total").isNull(), F.col("low")).otherwise((F.coalesce("own", F.lit(0.0)) - F.coalesce("off", F.lit(0.0)) + F.col("back") * F.col("low")) / F.col("total"))
        below = rows.select("g", p.alias("p"))
        below = checkpointed(below) if k < ORDER else below
    return below.select("g", F.ln("p").cast("float").alias("logp"))


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, g, n) of each text's distinct grams."""
    for b in batches:
        texts = b.column(1).to_pylist()
        for lo, hi in slices(texts):
            own = [np.unique(keys(t), return_counts=True) for t in texts[lo:hi]]
            of = pa.array(np.repeat(np.arange(lo, hi), [len(g) for g, _ in own]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), pa.array(np.concatenate([g for g, _ in own])), pa.array(np.concatenate([n for _, n in own]).astype(np.int64))], ["row", "g", "n"])


def _joined(docs: DataFrame, scored: DataFrame) -> DataFrame:
    """(row, mean) by a join of every gram of every document; rows of one key have one text, so their mean is the same."""
    grams = docs.select("row", "t").mapInArrow(_gram_batches, "row long, g long, n long")
    sums = grams.join(scored.hint("merge"), "g").groupBy("row").agg(F.sum(F.col("n") * F.col("logp")).alias("s"), F.sum("n").alias("n"))
    return sums.select("row", (F.col("s") / F.col("n")).alias("mean"))


def score(docs: DataFrame, scored: DataFrame | None, weights: dict[str, float] | None = None, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, lang, perplexity, n, toxic_score) of every row of docs, from all its grams' (g, logp).

    perplexity is null for empty text, or without a model; n counts the characters
    scored. Up to most_broadcast grams are looked up in a broadcast table, more in a
    join; both give the same.
    """
    heavy = {w.encode(): v for w, v in (weights or {}).items()}
    rows = docs.select("doc_id", "lang", row_key("doc_id", "text").alias("row"), utf8("text").alias("t"))
    small = scored is not None and scored.count() <= most_broadcast
    table = None
    if small:
        found = scored.toPandas().sort_values("g")
        table = rows.sparkSession.sparkContext.broadcast((found["g"].to_numpy(), found["logp"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, logp = table.value if table else (None, None)
        for b in batches:
            texts = b.column(3).to_pylist()
            n, mean = [], []
            for lo, hi in slices(texts):
                own = [keys(t) for t in texts[lo:hi]]
                n += map(len, own)
                if grams is None or not sum(map(len, own)):
                    mean += [None] * len(own)
                    continue
                distinct, at = np.unique(np.concatenate(own), return_inverse=True)
                values = logp[np.searchsorted(grams, distinct)].astype(np.float64)[at]
                upto = np.r_[0, np.cumsum(values)]
                ends = np.cumsum([0, *map(len, own)])
                mean += [(upto[j] - upto[i]) / (j - i) if j > i else None for i, j in zip(ends, ends[1:])]
            worst = [toxic.passage_score(toxic.words_of(t), heavy) if heavy else 0.0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(mean, pa.float64()), pa.array(n, pa.int64()), pa.array(worst, pa.float64())], ["doc_id", "lang", "row", "mean", "n", "toxic_score"])

    out = rows.mapInArrow(run, "doc_id long, lang string, row long, mean double, n long, toxic_score double")
    if scored is not None and not small:
        out = out.drop("mean").join(_joined(rows, scored), "row", "left")
    return out.select("doc_id", "lang", F.exp(-F.col("mean")).alias("perplexity"), "n", "toxic_score")


def trusted(labels: DataFrame) -> DataFrame:
    """(doc_id) of the documents that are labelled as good and not as toxic."""
    return toxic.labelled(labels).where("good").select("doc_id")


def fit(docs: DataFrame, text: DataFrame) -> DataFrame | None:
    """(g, logp) of all grams of docs, from the grams of all of text (a column t of bytes); None without any."""
    counts = checkpointed(gram_counts(text))
    if counts.isEmpty():
        return None
    grams = docs.where("text is not null").select(utf8("text").alias("t"))
    return saved(probabilities(counts, saved(gram_counts(grams).select("g"))))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 1.5) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) for every row of docs.

    A language's threshold is `slack` times the quantile of the perplexities of its
    trusted documents, in steps of one hundredth of a log unit; languages with fewer
    than LEAST_TRUSTED of them, null included, take the threshold of all trusted
    documents. For a text of n characters it is higher by the factor exp(SHORT / sqrt(n)),
    as the mean over few characters scatters. A passage with more of the toxic label's
    words than the same quantile of the trusted documents have isn't kept either. Empty
    or null text has no perplexity and isn't kept; without trusted text all other rows
    are. Rows that repeat a doc_id are scored each by its own text; only doc_id, lang
    and text are read; texts of any length are read whole; an empty table gives an empty one.
    """
    good = trusted(labels)
    texts = toxic.labelled_texts(docs, labels)
    scored = fit(docs, texts.where("good").select(utf8("text").alias("t")))
    weights = toxic.lexicon(texts) if scored is not None else {}
    scores = checkpointed(score(docs, scored, weights))
    known = scores.where("perplexity is not null").join(good, "doc_id", "left_semi")
    bins = known.groupBy("lang", F.round(F.ln("perplexity") / _BIN).alias("bin")).count().collect()
    by: dict[str | None, list] = {}
    for r in bins:
        by.setdefault(r["lang"], []).append((r["bin"] * _BIN, r["count"]))
    whole = binned_quantile([x for v in by.values() for x in v], quantile)
    limit = {k: slack * float(np.exp(binned_quantile(v, quantile))) for k, v in by.items() if k is not None and sum(n for _, n in v) >= LEAST_TRUSTED}
    rest: Column = F.lit(slack * float(np.exp(whole)) if whole is not None else float("inf"))
    if limit:
        rest = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in sorted(limit.items()) for x in (k, v))), F.coalesce("lang", F.lit(""))), rest)
    empty = F.col("n") == 0
    scatter = F.exp(F.lit(SHORT) / F.sqrt(F.greatest(F.col("n"), F.lit(1)).cast("double")))
    clean = F.col("toxic_score") <= toxic.limit(scores, good, quantile) if weights else F.lit(True)
    rows = scores.select("doc_id", "lang", "perplexity", (rest * scatter).alias("threshold"), clean.alias("clean"), (empty & F.lit(scored is not None)).alias("empty"))
    return rows.withColumn("kept", ~F.col("empty") & F.col("clean") & (F.coalesce(F.col("perplexity"), F.lit(0.0)) <= F.col("threshold"))).drop("clean", "empty")
