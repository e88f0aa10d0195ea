import random
from collections import Counter

import numpy as np
import pytest

from discern.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, at string"


def test_targets():
    assert mixing.targets({}) == {}
    got = mixing.targets({"b": 100, "a": 100, None: 100})
    assert got == {"a": pytest.approx(187.5), "b": pytest.approx(75), None: pytest.approx(37.5)}
    got = mixing.targets({"a": 1, "b": 100, "c": 0, None: 1000})
    assert got["a"] == 3 and got["c"] == 0 and sum(got.values()) == pytest.approx(1101)
    assert got["b"] == pytest.approx(300)
    assert mixing.targets({"a": 0}) == {"a": 0}


def test_permutation():
    for n in (1, 2, 3, 5, 17, 1000, 4097):
        for key in (0, 99):
            got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(got) == list(range(n))
    big = [mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k, np.uint64)) for k in (1, 2)]
    assert (big[0] != big[1]).mean() > 0.9 and (big[0] != np.arange(1000)).mean() > 0.9


def test_draws_deal_out_all_slots():
    rows = list(mixing.draws([50, 0, 7, 300], 64, 1))
    by = Counter()
    for shard, s, first, n in rows:
        assert first == by[s]
        by[s] += n
    assert [by[i] for i in range(4)] == [50, 0, 7, 300]
    sizes = Counter()
    for shard, _, _, n in rows:
        sizes[shard] += n
    assert all(v == 64 for k, v in sizes.items() if k < max(sizes))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    rows = [(i if i % 7 else None, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(400))), rng.choice(["a", "b", "c", None, ""]), 1, "x") for i in range(120)]
    rows += [(5, None, "a", 1, "x"), (5, None, "a", 1, "x"), (6, " \n", "d", 1, "x"), (9, "word " * 30_000, "a", 1, "x"), (8, "tiny", "solo", 1, "x"), (8, "tiny", "solo", 1, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def test_taken(docs):
    rows = mixing.taken(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, target, cap = Counter(), Counter(), {}, {}
    for r in rows:
        key = (r["source_size"], r["target"])
        sizes[key] += r["size"]
        taken[key] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
        target[key], cap[key] = r["target"], r["source_size"]
    for key in target:
        assert abs(taken[key] - target[key]) <= 1 and sizes[key] == cap[key]
    again = mixing.taken(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixed_blocks_hold_what_is_taken(docs):
    blocks = mixing.mixed_blocks(docs).collect()
    rows = mixing.taken(docs).collect()
    assert sum(b["n_words"] for b in blocks) == sum(r["taken"] for r in rows)
    assert all(len(b["text"].split()) == b["n_words"] <= mixing.BLOCK_WORDS for b in blocks)
    assert len({(b["source"], b["slot"]) for b in blocks}) == len(blocks)
    ids = {d for b in blocks for d in b["doc_ids"]}
    assert ids <= {r["doc_id"] for r in rows}


def test_each_document_is_taken_as_the_blocks_say(spark):
    rng = random.Random(7)
    rows = [(i if i % 5 else None, " ".join(f"d{i}w{k}" for k in range(rng.choice([0, 3, 50, 700]))), rng.choice(["a", "b", "c", None])) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.plan(df, block_words=32, shard_slots=8)
    count = Counter(w.split("w")[0] for b in mixing.mixed_blocks(df, mix).collect() for w in b["text"].split())
    took = sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in mixing.taken(df, mix).collect())
    assert took == sorted((str(d), len(t.split()), count[f"d{i}"]) for i, (d, t, _) in enumerate(rows))


def test_groups_of_shards_and_ranges_of_buckets(spark, docs, monkeypatch):
    want = sorted((str(r["doc_id"]), r["size"], r["source_size"]) for r in mixing.taken(docs).collect())
    for name, n in (("SHARDS", 3), ("BUCKETS", 5)):
        monkeypatch.setattr(mixing, name, n)
    mix = mixing.plan(docs, block_words=16, shard_slots=8)
    slots = mix.slots.collect()
    assert sorted((r["sid"], r["slot"]) for r in slots) == [(i, k) for i, s in enumerate(mix.sources) for k in range(s.slots(16))]
    sizes = Counter(r["shard"] for r in slots)
    assert max(sizes.values()) == 8 and len(sizes) == -(-len(slots) // 8)
    at = sorted((r["sid"], r["at"], r["size"]) for r in mix.with_offsets(mix.sized).collect())
    assert all(x[1] + x[2] == y[1] for x, y in zip(at, at[1:]) if x[0] == y[0])
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"]) for r in mixing.taken(docs, mix).collect()) == want


def test_too_many_sources(docs, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.plan(docs)


def test_empty(spark, docs):
    assert mixing.taken(docs.limit(0)).count() == 0 and mixing.mixed_blocks(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (None, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.taken(blank).collect()] == [0, 0] and mixing.mixed_blocks(blank).count() == 0
