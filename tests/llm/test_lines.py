import random

import pytest
from pyspark.sql import functions as F

from discern.llm import line_dedup

LINE = "this line is long enough to count as one"


def brute_lines(rows):
    """What line dedup has to give: rows of (doc_id, text) without equal ids."""

    def near(a, b):
        if len(a) < line_dedup.LEAST_LENGTH or len(b) < line_dedup.LEAST_LENGTH or abs(len(a) - len(b)) > 1:
            return False
        a, b = sorted((a, b), key=len)
        i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]

    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    lines = list(dict.fromkeys(x for _, t in rows for x in (t or "").split("\n") if x.strip()))
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(lines):
        for y in lines[:i]:
            if near(x, y):
                root[find(x)] = find(y)
    seen, out = set(), []
    for d, t in rows:
        kept = []
        for x in t.split("\n") if t else []:
            if x.strip():
                if find(x) in seen:
                    continue
                seen.add(find(x))
            kept.append(x)
        out.append((d, "\n".join(kept), len(t.split("\n")) if t else 0, len(kept)))
    return out


def run(df):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_lines"] - r["n_removed"]) for r in line_dedup.dedup_lines(df).collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    pool = ["".join(rng.choice("abc de") for _ in range(rng.randrange(3, 60))) for _ in range(25)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(8)):
            x = list(rng.choice(pool))
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(x))
                rng.choice([lambda: x.__setitem__(k, "z"), lambda: x.insert(k, "y"), lambda: x.pop(k)])()
                x = x or ["q"]
            lines.append("".join(x) if rng.random() < 0.9 else "  ")
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (None, pool[0] + "\n" + LINE), (101, "\n\n" + LINE + "é\n\n"), (102, LINE + "\n" + LINE), (103, "w " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' key", "1 h", "2 n_lines", "'x' kept_lines")
    assert run(df) == brute_lines(rows)
    assert {"key", "h", "kept_lines"} <= set(line_dedup.dedup_lines(df).columns)


def test_hot_segments_lose_no_link(spark, monkeypatch):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(70))
    rows = [(0, base)]
    for i in range(1, 120):
        k = rng.randrange(70)
        rows.append((i, rng.choice([base[:k] + rng.choice("xyzw") + base[k + 1 :], base[:k] + rng.choice("xyzw") + base[k:], base[:k] + base[k + 1 :], base[:k] + "QQQ" + base[k + 3 :]])))
    monkeypatch.setattr(line_dedup, "HOT", 5)
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute_lines(rows)


def test_lines_edges(spark):
    df = spark.createDataFrame([(1, LINE), (1, LINE), (2, LINE)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(df).collect()) == [(1, LINE), (1, LINE), (2, "")]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("ids", [(1, 1, 2), (None, None, None)])
def test_rows_that_share_an_id_or_have_none_lose_no_text(spark, ids):
    other = LINE.replace("enough", "enaugh")
    for texts in ((LINE, "x\n" + LINE, LINE), (LINE, "x\n" + LINE, other)):
        rows = line_dedup.dedup_lines(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()
        lines = [x for r in rows for x in r["text"].split("\n") if x]
        assert len(rows) == 3 and sum(x in (LINE, other) for x in lines) in ((1,) if len(set(zip(ids, texts))) == 3 else (1, 2))
        assert sorted(x for x in lines if len(x) == 1) == sorted(x for t in texts for x in t.split("\n") if len(x) == 1)


def test_many_lines_of_one_hole_make_few_links(spark):
    rng = random.Random(12)
    holes = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice((7, 8)))) for _ in range(1500)]
    lines = sorted({"the same words stand in front of it " + h + " and the same words stand behind it" for h in holes})
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    rows = line_dedup._rows(df)
    keys = rows.select(F.xxhash64("line").alias("h"), *(line_dedup._segment(*v).alias(k) for k, v in line_dedup._KINDS.items()))
    assert line_dedup.similar_lines(rows, keys).count() < 40 * len(lines)
    assert run(df) == brute_lines([(i, x) for i, x in enumerate(lines)])


def test_banded_distance(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    rng = random.Random(13)
    pairs = [("", ""), ("a", ""), ("", "b"), ("ab", "ba"), ("é😀x", "é😀y")]
    for _ in range(400):
        a = [rng.choice("abé") for _ in range(rng.randrange(20))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice("abc") * rng.randrange(2)
        pairs.append(("".join(a), "".join(b)))
    for edits in (1, 2, 4):
        got = {r["i"] for r in line_dedup.within(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x string, y string"), "x", "y", edits).collect()}
        assert got == {i for i, p in enumerate(pairs) if distance(*p) <= edits}


def test_short_lines_are_compared(spark):
    rows = [(1, "a short line here.\nsection 1\nab cd ef"), (2, "a short line hera.\nab cd e\nab cd efg"), (3, "a short line.\nab cd e"), (4, "tiny 1\ntiny 2")]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute_lines(rows)
    rng = random.Random(14)
    short = ["".join(rng.choice("ab ") for _ in range(rng.randrange(7, 24))) for _ in range(300)]
    rows = [(i, "\n".join(short[i * 10 : i * 10 + 10])) for i in range(30)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute_lines(rows)


def test_many_repeated_lines_of_one_document(spark):
    """Twice the lines take about twice the time; by pairs it would be four times."""
    import time

    took = []
    for n in (10_000, 10_000, 40_000):
        text = "\n".join(f"{i:08d} a line of its own here {i:08d}" for i in range(n))
        df = spark.createDataFrame([(1, text), (2, text + "\nthe end")], "doc_id long, text string").repartition(2)
        began = time.perf_counter()
        out = {r["doc_id"]: r for r in line_dedup.without(df, df.where("doc_id = 2").select(line_dedup.row_key("doc_id", "text").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos"))).collect()}
        took.append(time.perf_counter() - began)
        assert out[1]["n_removed"] == 0 and out[2]["text"] == "the end" and out[2]["n_removed"] == n
    assert took[2] < 10 * took[1] + 2
