import random

from discern.llm import decontam


def test_items_that_a_third_of_the_rows_hold(spark):
    rng = random.Random(4)
    rare = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    prose = lambda n: [rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n)]
    items = [" ".join(prose(30)) for _ in range(10)]
    copy = " ".join([*prose(50), items[0], *prose(50)])
    docs = [(i, copy if i < 70 else " ".join([*prose(40), *([items[1]] if i < 140 else []), *([items[2]] if i == 150 else []), *prose(40)])) for i in range(210)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(i, i // 70) for i in range(140)} | {(150, 2)}


def test_items_that_nearly_all_rows_hold(spark):
    rng = random.Random(5)
    rare = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    prose = lambda n: [rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n)]
    items = [" ".join(prose(30)) for _ in range(4)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for held in (12, 39, 40):
        docs = [(i, " ".join([*prose(60), *([items[0]] if i < held else []), *prose(60)])) for i in range(40)]
        got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
        assert got == {(i, 0) for i in range(held)}
