import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from discern.llm import vector_codes, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, error string, code int"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA).repartition(5)


def random_rows(n, length=32, seed=3):
    rng = random.Random(seed)
    # few values, so that distances tie and vectors repeat
    return [(i, [rng.choice((-1.0, -0.5, 0.25, 0.0, 0.004, 3.0)) for _ in range(length)], rng.choice((None, 1, 2, 3))) for i in range(n)]


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    q = [[math.floor(256 * x) for x in v] for _, v, _ in kept]
    m = len(q[0]) // parts
    split = [[tuple(x[p * m : p * m + m]) for p in range(parts)] for x in q]
    firsts = {}
    for (i, _, _), x in zip(kept, split):
        if i is not None:
            firsts[i] = min(x, firsts.get(i, x))
    books = [[firsts[i][p] for i in sorted(firsts)[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            groups = {}
            for x in split:
                groups.setdefault(near(x[p], book)[1], []).append(x[p])
            new.append([tuple(sum(c) // len(groups[e]) for c in zip(*groups[e])) if e in groups else c for e, c in enumerate(book)])
        books = new
    found = [[near(x[p], books[p]) for p in range(parts)] for x in split]
    errors = [sum(d for d, _ in f) for f in found]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    totals = {}
    for (_, _, label), e in zip(kept, errors):
        totals[label] = totals.get(label, 0) + e
    return sorted((str(i), "".join(f"{e:02x}" for _, e in f), err, totals[label], digest) for (i, _, label), f, err in zip(kept, found, errors))


EDGES = [(9000, None, 1), (9001, [], 1), (9002, [None] + [0.0] * 31, 1), (9003, [NAN] * 32, 2), (9004, [INF] + [1.0] * 31, None), (9005, [-INF] + [1.0] * 31, None), (None, [0.5] * 32, None), (None, [0.5] * 32, 1), (5, [9.0] * 32, 2), (5, [-9.0] * 32, 2)]


@pytest.mark.parametrize("n", [1, 40, 400])
def test_codes_match_brute_force(spark, n):
    rows = random_rows(n) + EDGES
    rows += rows[:3]
    got = vector_codes.codes(table(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == brute_codes(rows)


def test_search_equals_a_full_scan_from_any_start():
    rng = np.random.default_rng(5)
    for spread in (2, 9, 4000):
        book = rng.integers(-spread, spread, (4, 37, 3))
        x = rng.integers(-spread, spread, (500, 4, 3))
        start = rng.integers(0, 37, (500, 4))
        at, distance = vector_codes.Neighbours(book).nearest(x, start)
        full = ((x[:, :, None, :] - book[None]) ** 2).sum(3)
        assert (at == full.argmin(2)).all() and (distance == full.min(2)).all()


def test_salted_labels_agree_with_broadcast_ones(spark, monkeypatch):
    rows = table(spark, random_rows(300) + EDGES)
    want = sorted(map(str, vector_codes.codes(rows).collect()))
    monkeypatch.setattr(vector_codes, "MOST_BROADCAST", 1)
    assert sorted(map(str, vector_codes.codes(rows).collect())) == want


def test_lengths_and_empty_tables(spark):
    assert vector_codes.codes(table(spark, [])).collect() == []
    assert vector_codes.codes(table(spark, [(1, None, 1)])).collect() == []
    assert vector_codes.codes(table(spark, [(None, [1.0] * 16, 1)])).collect() == []
    mixed = [(1, [1.0] * 16, 1), (2, [1.0] * 32, 1), (3, [2.0] * 32, 1)]
    assert sorted(r.vec_id for r in vector_codes.codes(table(spark, mixed)).collect()) == [2, 3]
    with pytest.raises(ValueError):
        vector_codes.codes(table(spark, [(1, [1.0] * 17, 1)]))
    with pytest.raises(Exception, match="too large"):
        vector_codes.codes(table(spark, [(1, [1e30] * 16, 1)])).collect()


def brute_white(rows, most=8):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v, *_ in kept], dtype=np.longdouble)
    n, s = len(x), [int(c) for c in x.sum(0)]
    centred = x - np.array(s, dtype=np.longdouble) / n
    values, vectors = np.linalg.eigh(np.float64(centred.T @ centred / n))
    white = np.float64(centred) @ vectors[:, ::-1][:, :most] / np.sqrt(values[::-1][:most])
    deviation = [sum((n * int(c) - t) ** 2 for c, t in zip(r, s)) for r in x]
    return kept, n, deviation, white, values[::-1][:most] / values.sum()


def test_whitening_matches_a_direct_computation(spark):
    rng = np.random.default_rng(8)
    mix = rng.normal(size=(12, 12)) * np.arange(1, 13)
    rows = [(i, (rng.normal(size=12) @ mix + 40).tolist(), 1) for i in range(700)] + [(9000, None, 1), (9001, [NAN] * 12, 1), (9002, [None] * 12, 1), (9003, [INF] * 12, 1), (9004, [], 1)]
    kept, n, deviation, white, explained = brute_white(rows)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(table(spark, rows)).collect()}
    assert len(got) == 8 * len(kept) == 8 * 700
    for c in range(8):
        turn = math.copysign(1, got[0, c + 1].whitened * white[0, c])
        for k, (i, *_) in enumerate(kept):
            r = got[i, c + 1]
            assert (r.n, r.deviation) == (n, deviation[k])
            assert abs(turn * r.whitened - white[k, c]) < 1e-8
            assert abs(r.explained / explained[c] - 1) < 1e-8 and 0 <= r.identity_error < 1e-8


def test_merging_is_stable_far_from_zero():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 50, (3000, 5)) + 10**9
    want = np.cov((x - 10**9).T, bias=True) * len(x)
    for cuts in ([], [1], [1, 2, 3], list(range(7, 3000, 7))):
        whole = None
        for part in np.split(x, cuts):
            here = whitening.moments(part)
            whole = whitening.merged(whole, here) if whole else here
        n, _, scatter, sums = whole
        assert n == len(x) and sums.tolist() == x.sum(0).tolist()
        assert np.abs(scatter - want).max() < 1e-7 * want.max()


def test_whitening_without_spread(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    one = whitening.whiten(table(spark, [(None, [1.0, 2.0, 3.0], 1), (None, [1.0, 2.0, 3.0], 1), (4, [1.0], 1)])).collect()
    assert len(one) == 6 and {(r.vec_id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(None, 2, 0, None, None, None)}
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 0.0], 1) for i in range(9)])).collect()
    assert len(line) == 27
    assert all(r.whitened is None and r.explained == 0 for r in line if r.component > 1)
    assert all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-12 for r in line if r.component == 1)


def test_deviation_beyond_a_long(spark):
    rows = table(spark, [(1, [float(2**21)], 1), (2, [-float(2**21)], 1), (3, [0.0], 1)])
    got = {r.vec_id: r.deviation for r in whitening.whiten(rows).collect()}
    assert got == {1: None, 2: None, 3: 0}
    near = table(spark, [(1, [float(2**20)], 1), (2, [-float(2**20)], 1), (3, [0.0], 1)])
    want = 9 * (2**30) ** 2
    got = {r.vec_id: r.deviation for r in whitening.whiten(near).collect()}
    assert got == ({1: None, 2: None, 3: 0} if want >= 2**63 else {1: want, 2: want, 3: 0})


def test_whitening_reads_its_table(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    out = whitening.whiten(rows)
    got = out.groupBy("component").agg(F.avg("whitened").alias("m"), F.var_pop("whitened").alias("v"), F.max("identity_error").alias("e")).collect()
    assert len(got) == 8 and all(abs(r.m) < 1e-8 and abs(r.v - 1) < 1e-8 and r.e < 1e-8 for r in got)
