"""Language identification by a string kernel.

A text is the set of its character 1-, 2- and 3-grams (a blended spectrum of n-gram
presence). The kernel of two texts is the normalised number of grams they share. A few
landmark texts span a Nyström approximation of it, in which one-versus-rest ridge
regression is solved; a batch of texts is scored by two matrix products. Grams are
hashed to BUCKETS, so grams of one bucket count as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets of the 1-, 2- and 3-grams.
BUCKETS = (512, 2048, 4096)
UNKNOWN = "und"
_BATCH = 256
_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points; every run of other characters than letters becomes one blank."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = np.where(c < 0x3000, _LETTER[np.minimum(c, 0x2FFF)], True)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, c, 32)[keep].astype(np.uint64)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def presence(texts: list[str]) -> np.ndarray:
    """A 0/1 row of grams for each text, scaled to length 1."""
    x = np.zeros((len(texts), sum(BUCKETS)), np.float32)
    for row, text in zip(x, texts):
        c, base = _codes(text), 0
        for n, size in enumerate(BUCKETS, 1):
            if len(c) < n:
                break
            h = np.zeros(len(c) - n + 1, np.uint64)
            for k in range(n):
                h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            row[base + (h % np.uint64(size)).astype(np.int64)] = 1
            base += size
        if (total := row.sum()) > 0:
            row /= np.sqrt(total)
    return x


@dataclass
class Model:
    labels: list[str]
    landmarks: np.ndarray  # m x grams
    alpha: np.ndarray  # m x labels

    def scores(self, texts: list[str]) -> np.ndarray:
        return (presence(texts) @ self.landmarks.T) @ self.alpha


def train(rows: np.ndarray, langs: list[str], landmarks: int = 192, ridge: float = 1e-2) -> Model | None:
    """One-versus-rest kernel ridge regression on rows of presence(); landmarks are dealt evenly to the languages."""
    labels = sorted(set(langs))
    if not labels:
        return None
    by = {x: [i for i, y in enumerate(langs) if y == x] for x in labels}
    chosen = sorted(i for x in labels for i in by[x][: max(1, landmarks // len(labels))])
    marks = rows[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.c_[(rows @ marks.T) @ root]
    y = np.where(np.array(langs)[:, None] == np.array(labels), 1.0, -1.0)
    # rows weigh so that each language counts alike
    weight = np.array([1 / len(by[x]) for x in langs])[:, None]
    w = np.linalg.solve(z.T @ (weight * z) + ridge * np.eye(z.shape[1]) * weight.sum() / len(z), z.T @ (weight * y))
    return Model(labels, marks, (root @ w).astype(np.float32))


def _presence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        for lo in range(0, len(texts), _BATCH):
            use = [i for i in range(lo, min(lo + _BATCH, len(texts))) if _has_letter(texts[i])]
            bits = np.packbits(presence([texts[i] for i in use]) > 0, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(use, pa.int64())), pa.array([x.tobytes() for x in bits], pa.binary())], ["place", "bits"])


def fit(docs: DataFrame, per_language: int = 400, most_languages: int = 1000) -> Model | None:
    """Learns from text and non-null lang of the rows that held_out() leaves.

    The bound is on training documents: those of smallest hashed doc_id, at most
    `per_language` for each language. The driver gets their grams, a bit for each bucket
    (832 bytes) however long the text; more than most_languages is an error. None if no
    row has a language.
    """
    rows = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not counts:
        return None
    place = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(2.0 * per_language / r["count"]))))
    near = rows.where(place < F.try_element_at(share, F.col("lang"))).select(F.struct("lang", place.alias("p"), "doc_id").alias("place"), "text")
    found = near.mapInArrow(_presence_batches, "place struct<lang:string,p:double,doc_id:long>, bits binary")
    by: dict[str, list] = {}
    for r in sorted(found.collect(), key=lambda r: (r["place"]["p"], r["place"]["doc_id"], r["bits"])):
        if len(got := by.setdefault(r["place"]["lang"], [])) < per_language:
            got.append(r["bits"])
    pairs = [(bits, x) for x, own in sorted(by.items()) for bits in own]
    if not pairs:
        return None
    phi = np.unpackbits(np.frombuffer(b"".join(bits for bits, _ in pairs), np.uint8).reshape(len(pairs), -1), axis=1)[:, : sum(BUCKETS)].astype(np.float32)
    return train(phi / np.sqrt(np.maximum(phi.sum(1, keepdims=True), 1)), [x for _, x in pairs])


def held_out():
    """True where crc32 of the doc_id as text leaves 1 modulo 3 (null doc_id: false)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict_texts(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    use = [i for i, t in enumerate(texts) if model and _has_letter(t)]
    for at in range(0, len(use), _BATCH):
        part = use[at : at + _BATCH]
        s = model.scores([texts[i] for i in part])
        for i, k, v in zip(part, s.argmax(1), s.max(1)):
            langs[i], scores[i] = model.labels[k], float(np.clip((1 + v) / 2, 0, 1))
    return langs, scores


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with lang_pred and score (0 to 1).

    Null text or text without a letter gives `und` with score 0; so does every text if
    there was nothing to learn from. Columns of these names in docs are replaced.
    """
    model = model or fit(docs)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = predict_texts(model, b.column(keep.index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep).mapInArrow(run, schema)


def recognised(docs: DataFrame, model: Model | None = None, languages: list[str] | None = None) -> DataFrame:
    """docs in one of `languages` (default: any that was learned), with the predicted language as lang.

    Null texts and texts without a letter are in none and go. Where there was nothing to
    learn from, nothing is predicted and all rows stay as they are. Repeated rows are
    judged each; other columns stay, whatever their names.
    """
    model = model or fit(docs)
    if model is None:
        return docs
    names = docs.columns
    at, to = names.index("text"), names.index("lang")
    wanted = set(model.labels if languages is None else languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, _ = predict_texts(model, b.column(at).to_pylist())
            columns = list(b.columns)
            columns[to] = pa.array(langs, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array([x in wanted for x in langs]))

    return docs.mapInArrow(run, docs.schema)


def predictions(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs; only doc_id and text are read.

    Null texts and texts without a letter are `und` with score 0. Repeated rows give a row
    each, by their own text; a null doc_id is held out by no fold. Texts of any length are
    read whole, one at a time. An empty table gives an empty one.
    """
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = predict_texts(model, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
