import random

import pytest

from discern.llm import decontam as dc

RNG = random.Random(7)
COMMON = ["the", "of", "and", "to", "in"]
RARE = ["".join(RNG.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]


def prose(n, rng=RNG):
    return [rng.choice(COMMON) if rng.random() < 0.4 else rng.choice(RARE) for _ in range(n)]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(row[j], row[j - 1], last + (x == y))
    return row[-1]


def test_lcs():
    for _ in range(50):
        a, b = ([RNG.choice(b"abc") for _ in range(RNG.randrange(1, 90))] for _ in range(2))
        assert dc.lcs_length(a, b) == brute_lcs(a, b)


def test_bound_is_exact():
    item = dc.Item(1, [b"a", b"b", b"c", b"d"], [b"d"])
    assert dc.verify(item, [b"x", b"a"], 0.75)[2] is False
    assert dc.verify(item, [b"a", b"x", b"b", b"d"], 0.75) == (0.75, 1.0, True)
    assert dc.verify(item, [b"d", b"c", b"b", b"a"], 0.75)[2] is False


@pytest.fixture(scope="module")
def tables(spark):
    items = [(k, " ".join(prose(20 + k)).capitalize() + ".") for k in range(30)]
    docs = [(i, " ".join(prose(RNG.randrange(10, 600))), "x", 1) for i in range(150)]
    truth = set()
    for i in range(0, 150, 5):
        k = i % 30
        words = docs[i][1].split()
        at = RNG.randrange(len(words))
        text = items[k][1]
        if i % 10 == 0:  # a paraphrase: every sixth word is another
            text = " ".join(w if n % 6 else "zzz" for n, w in enumerate(text.split(), 1))
        docs[i] = (i, " ".join([*words[:at], text, *words[at:]]), "x", 1)
        truth.add((i, k))
    docs += [(900, items[3][1], "x", 1), (900, items[3][1], "x", 1), (None, items[4][1].upper(), "x", 1), (901, None, "x", 1), (902, "", "x", 1)]
    truth |= {(900, 3), (None, 4)}
    bench = [*items, (98, None), (99, " . ")]
    return spark.createDataFrame(docs, "doc_id long, text string, __leak_key string, item_id int"), spark.createDataFrame(bench, "item_id long, text string"), truth


def test_all_planted_leaks_and_no_other(tables):
    docs, bench, truth = tables
    rows = dc.find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == truth
    assert sum(r["doc_id"] == 900 for r in rows) == 2
    assert all(r["first_word"] <= r["last_word"] for r in rows)


def test_filter(tables):
    docs, bench, truth = tables
    kept = dc.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - {d for d, _ in truth}


def test_rows_are_judged_not_ids(spark, tables):
    _, bench, _ = tables
    item = bench.where("item_id = 3").first()["text"]
    clean = " ".join(prose(60))
    docs = spark.createDataFrame([(1, item), (1, clean), (None, item), (None, clean), (None, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in dc.without_leaks(docs, bench).collect()) == sorted([("1", clean), ("None", clean), ("None", "")])


def test_empty(tables):
    docs, bench, _ = tables
    assert dc.find_leaks(docs, bench.limit(0)).count() == 0
    assert dc.find_leaks(docs.limit(0), bench).count() == 0
    assert dc.without_leaks(docs.limit(0), bench).count() == 0


def test_too_many_items(tables):
    docs, bench, _ = tables
    with pytest.raises(ValueError):
        dc.build(docs, bench, most_items=3)


def test_answers_decide_paraphrases(spark):
    words = RARE[:40]
    half = " ".join(w if n % 5 in (0, 2, 4) else "q" for n, w in enumerate(words))
    docs = spark.createDataFrame([(1, half), (2, half), *((10 + i, " ".join(prose(300))) for i in range(40))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words), "alpha beta")], "item_id long, text string, answer string")
    assert dc.find_leaks(docs, bench).count() == 0
    told = docs.selectExpr("doc_id", "if(doc_id = 1, concat(text, ' alpha beta'), text) text")
    assert [r["doc_id"] for r in dc.find_leaks(told, bench).collect()] == [1]


@pytest.mark.parametrize("replaced, least", [(0, 1.0), (6, 1.0), (4, 0.9)])
def test_recall_of_paraphrases(spark, replaced, least):
    rng = random.Random(20 + replaced)
    items = [" ".join(prose(rng.randrange(20, 60), rng)) for _ in range(100)]
    docs, truth = [], set()
    for i, text in enumerate(items):
        other = " ".join(w if not replaced or n % replaced else rng.choice(RARE) for n, w in enumerate(text.split(), 1))
        docs.append((i, " ".join([*prose(rng.randrange(200), rng), other, *prose(rng.randrange(200), rng)])))
        truth.add((i, i))
    docs += [(100 + i, " ".join(prose(300, rng))) for i in range(100)]
    got = {(r["doc_id"], r["item_id"]) for r in dc.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert len(got & truth) >= least * len(truth) and not got - truth


def test_items_and_windows_in_blocks(spark, tables, monkeypatch):
    docs, bench, _ = tables
    index = dc.build(docs, bench)
    texts = [(r["text"] or "").encode() for r in docs.collect()]
    want = sorted(dc.search(texts, index))
    for name, n in (("WINDOWS", 7), ("ITEMS", 2), ("GATHERED", 50)):
        monkeypatch.setattr(dc, name, n)
    got = sorted(dc.search(texts, index))
    assert [(d, k) for d, k, *_ in got] == [(d, k) for d, k, *_ in want]
