import random

import pyarrow.parquet as pq
import pytest

from discern.llm import token_counts
from discern.llm.token_counts import count_tokens, pieces

public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, n_tokens string, digest int"


def direct(tokenizer, texts):
    path = str(public_tokenizers.path(tokenizer))
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        known = Tokenizer.from_file(path)
        return [len(known.encode(t, add_special_tokens=False).ids) for t in texts]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [len(model.encode(t)) for t in texts]


def some_texts():
    rng = random.Random(4)
    bits = ["don't", "we'LL ", "naïve", " ", "  ", "\n\n", "\t", "12 345", "…", "🙂🙂", "日本語", "<|endoftext|>", "</s>", "a" * 50, "!?", " ", "é"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    return [None, "", " ", "\n", "<|endoftext|>", "a <|endoftext|> b", "word " * 700, *made]


@pytest.mark.parametrize("tokenizer", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, tmp_path, tokenizer):
    texts = some_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "twice"), (None, "twice"), (3, "another text"), (3, None), (0, "x")]
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], SCHEMA).repartition(3)
    got = count_tokens(docs, tokenizer, cache=str(tmp_path / "cache"))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    sizes = direct(tokenizer, [t or "" for _, t in rows])
    want = [(i, len((t or "").encode()), n, n > 512) for (i, t), n in zip(rows, sizes)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_only_distinct_misses_are_encoded(spark, tmp_path, monkeypatch):
    cache, encoded = str(tmp_path / "cache"), []
    whole = token_counts.counted

    def watched(texts, tokenizer):
        texts = texts.cache()
        encoded.append(sorted(r.text for r in texts.collect()))
        return whole(texts, tokenizer)

    monkeypatch.setattr(token_counts, "counted", watched)
    docs = lambda texts: spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    first = ["one two", "one two", None, "", "three"] * 40
    a = sorted(map(tuple, count_tokens(docs(first), cache=cache).collect()))
    b = sorted(map(tuple, count_tokens(docs(first), cache=cache).collect()))
    assert a == b and len(a) == len(first)
    count_tokens(docs(["three", "four", "four"]), cache=cache).collect()
    count_tokens(docs(["three"]), "word_bpe_49k.json", cache=cache).collect()  # another tokenizer has a cache of its own
    assert encoded == [["", "one two", "three"], [], ["four"], ["three"]]
    assert pq.read_table(cache).num_rows == 5


def test_counts_in_the_cache_are_used_and_repeats_in_it_do_no_harm(spark, tmp_path):
    cache = str(tmp_path / "cache")
    import hashlib

    known = [(bytearray(hashlib.sha256(b"known").digest()), 77, token_counts.version_of("byte_bpe_50k.json"))] * 2 + [(bytearray(hashlib.sha256(b"new").digest()), 99, "another version")]
    for _ in range(2):
        spark.createDataFrame(known, token_counts.CACHE).write.mode("append").partitionBy("version").parquet(cache)
    docs = spark.createDataFrame([(1, "known", "", 1), (2, "new", "", 1)], SCHEMA)
    assert sorted(map(tuple, count_tokens(docs, cache=cache).collect())) == [(1, 5, 77, False), (2, 3, 1, False)]


def test_hot_texts_and_empty_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "HOT_SHARE", 4)
    texts = ["hot text"] * 60 + [f"rare {i}" for i in range(100)]
    docs = spark.createDataFrame([(i, t, "", 1) for i, t in enumerate(texts)], SCHEMA)
    got = sorted(map(tuple, count_tokens(docs, cache=str(tmp_path / "a")).collect()))
    assert got == [(i, len(t), n, False) for (i, t), n in zip(enumerate(texts), direct("byte_bpe_50k.json", texts))]
    assert count_tokens(docs.limit(0), cache=str(tmp_path / "b")).collect() == []


def test_pieces_of_long_texts_share_no_token(spark):
    rng = random.Random(6)
    bits = ["don't ", "we'll", " naïve ", "  ", "\n", "12 345", " 7 ", "x" * 90, "日本語 ", "<|endoftext|>", " <|endoftext|> ", "  ", "é ", "a  b", "a\t b"]
    texts = ["".join(rng.choice(bits) for _ in range(800)) for _ in range(20)] + ["a" * 3000, "", " " * 3000]
    assert all("".join(pieces(t, 40)) == t for t in texts) and sum(len(list(pieces(t, 40))) for t in texts) > 500
    for t in texts:
        assert sum(direct("byte_bpe_50k.json", list(pieces(t, 40)))) == direct("byte_bpe_50k.json", [t])[0]
    long = "word and another, " * 60_000
    docs = spark.createDataFrame([(1, long, "", 1), (2, "z" * 400_000, "", 1)], SCHEMA)
    got = dict(count_tokens(docs).select("doc_id", "n_tokens").collect())
    assert [got[1], got[2]] == direct("byte_bpe_50k.json", [long, "z" * 400_000])
