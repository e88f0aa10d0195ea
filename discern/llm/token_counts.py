"""Token counts of texts, from a cache by digests.

A text is known by the SHA-256 of its content, a tokenizer by that of its file, its
library's version and the way it is called. Digests are joined with the cache's; of the
texts that it lacks each distinct one is encoded once, and its count appended. Only texts
that miss are exchanged, each task's copies put together before; rows then meet their
counts by digest alone.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import among, saved, shared_dir

TOKENIZER, LIMIT = "byte_bpe_50k.json", 512
#: Part of each tokenizer's version: another way to call the library needs another number.
CALL = "no added tokens, no truncation, no padding; 1"
CACHE = "digest binary, n_tokens long, version string"
#: A digest that holds more than one in so many rows meets its count by broadcast; there are at most so many of them.
HOT_SHARE = 1000
#: Characters that are encoded at once, at about; longer texts in pieces, where the tokenizer allows it.
PIECE = 1 << 18


def path_of(tokenizer: str) -> str:
    """A tokenizer's file: a path, or a name among the public tokenizers that are installed (looked up where it is used)."""
    if os.path.sep in tokenizer:
        return tokenizer
    import public_tokenizers

    return str(public_tokenizers.path(tokenizer))


def version_of(tokenizer: str) -> str:
    """Digest of the file, the library's version and the way of the call."""
    import sentencepiece
    import tokenizers

    library = f"tokenizers {tokenizers.__version__}" if tokenizer.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    with open(path_of(tokenizer), "rb") as f:
        return hashlib.sha256(f.read() + f"\0{library}\0{CALL}".encode()).hexdigest()


def _divisible(spec: dict) -> bool:
    """Can a text be cut before a blank that follows an ASCII letter or digit, without a change of its tokens?

    So it is with byte-level pre-tokens, which begin at such a blank whatever stands around it, if no
    normaliser looks further and no added token holds or takes in a blank.
    """
    pre = spec.get("pre_tokenizer") or {}
    plain = all(" " not in t["content"] and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens") or [])
    return plain and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """text cut before blanks behind an ASCII letter or digit, into pieces of at least `size` characters."""
    lo, at = 0, text.find(" ", size)
    while at > 0:
        if at - lo >= size and text[at - 1].isascii() and text[at - 1].isalnum():
            yield text[lo:at]
            lo, at = at, text.find(" ", at + size)
        else:
            at = text.find(" ", at + 1)
    yield text[lo:]


def counter(tokenizer: str) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of each of some texts, on one thread."""
    path = path_of(tokenizer)
    if not path.endswith(".json"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    known.no_truncation()
    known.no_padding()
    with open(path, encoding="utf-8") as f:
        divisible = _divisible(json.load(f))

    def count(texts: list[str]) -> list[int]:
        cut = [list(pieces(t)) if divisible else [t] for t in texts]
        sizes = iter([len(e) for e in known.encode_batch_fast([p for c in cut for p in c], add_special_tokens=False)])
        return [sum(next(sizes) for _ in c) for c in cut]

    return count


def counted(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of each row of texts (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for b in batches:
            count, held = count or counter(tokenizer), b.column(1).to_pylist()
            out: list[int] = []
            lo = size = 0
            for hi, t in enumerate(held):  # a few texts at a time, as an encoding takes far more room than its text
                if size and size + len(t) > PIECE:
                    out += count(held[lo:hi])
                    lo, size = hi, 0
                size += len(t)
            out += count(held[lo:]) if lo < len(held) else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def cached(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(digest, n_tokens) that the cache holds for a version of a tokenizer, each digest once; empty if there is no cache."""
    try:
        held = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        held = spark.createDataFrame([], CACHE)
    return held.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, cache: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row of docs (id, text): tokens of the whole text, without added ones.

    tokenizer: a .json file for tokenizers or a .model file for sentencepiece, by path or
    installed name. cache: a folder that all executors share (default: token-counts in the
    folder of spark.checkpoint.dir), to which new counts are appended; two runs at once may
    append the same counts, which does no harm, and a run that was cut short leaves whole rows
    or none. Content isn't changed before it is digested but for null, which counts as
    empty: 0 bytes, 0 tokens. Very long texts are encoded in pieces that can't share a token,
    if the tokenizer has such (byte level). Repeated rows and equal texts are encoded once,
    and give as many rows as they are; null and repeated ids are ids like others. An empty
    table gives an empty one; other columns don't matter.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared_dir(spark)}/token-counts"
    version = version_of(tokenizer)
    content = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(id).alias("id"), content.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = saved(texts.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    tally = saved(keys.groupBy("digest").agg(F.count("*").alias("n_rows")))
    misses = saved(tally.join(cached(spark, cache, version), "digest", "left_anti").select("digest", F.xxhash64("digest").alias("h")))
    near = among(texts.select("digest", "text", F.xxhash64("digest").alias("h")), "h", misses.select("h"))
    distinct = near.groupBy("digest").agg(F.first("text").alias("text")).join(misses.select("digest"), "digest", "left_semi")
    new = counted(distinct, tokenizer).withColumn("version", F.lit(version))
    new.write.mode("append").partitionBy("version").parquet(cache)
    counts = cached(spark, cache, version)
    # a digest with many rows is one of few, so that no task gets more than a small share of the rows
    hot = tally.where(F.col("n_rows") * HOT_SHARE > keys.count()).select("digest")
    hot = F.broadcast(counts.join(F.broadcast(hot), "digest", "left_semi").select("digest", F.col("n_tokens").alias("hot_tokens")))
    marked = keys.join(hot, "digest", "left")
    rare = marked.where("hot_tokens is null").drop("hot_tokens").join(counts, "digest")
    rows = rare.unionByName(marked.where("hot_tokens is not null").withColumnRenamed("hot_tokens", "n_tokens"))
    return rows.select(F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
