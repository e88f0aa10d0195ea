"""Bits by sentence against each pattern tested on each unit."""

import random

import pytest
from pyspark.sql import functions as F

from discern.functions import hits, rules
from discern.functions.patterns import evaluated, let_sql, pattern_sql
from discern.functions.text import sentences
from discern.operators import findings
from tests.test_patterns import example


def texts():
    """Lines of phrases, whole and broken over lines, with and without marks at their ends; lines repeat, and some hold two others."""
    rng = random.Random(17)
    patterns = hits.PATTERNS
    out = []
    for k in range(260):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            words = " ".join(rng.choice((example(rng.choice(patterns)), "filler words here", "nothing of note,", "Kname éname names", "do", "we share lots", "as long as")) for _ in range(rng.randrange(2, 6)))
            lines.append(words[:1].upper() + words[1:] + rng.choice((".", "!", "", "", ",", " -", "…")))
        if k % 3 == 0:  # phrases over one and two joins
            w = example(rng.choice([*hits.PHRASES, *hits.LONG, *hits.OPEN])).replace("s-", "s ").split()
            w = w if len(w) > 1 else ["third", "parties"]
            cut = rng.randrange(1, len(w))
            again = rng.randrange(cut, len(w) + 1)
            lines += ["Some leading words of the first " + " ".join(w[:cut]), " ".join(w[cut:again]) or "A whole sentence that stands between", " ".join(w[again:]) + " and some trailing words in the end"]
        if k % 4 == 0:
            lines += lines[:2] + [" ".join(lines[:2])] + lines[:1]
        out.append("\n".join(lines))
    long = [p for p in hits.LONG]
    for p in long:  # a phrase that holds a whole sentence
        w = example(p).split()
        out += [f"Here stand the words of {w[0]}\n{' '.join(w[1:-1])}\n{w[-1]} and what follows behind them", f"One sentence, of share xyz\n{'middle ' * 6}\nwith third parties at last"]
    return [*out, "", None, "no", "Only one sentence of some length."]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(4).persist()


def test_words_begin_every_match():
    for p in hits.PATTERNS:
        assert hits.starts(p) and not any(" " in w for w in hits.starts(p))
        words = example(p).lower().replace("'", " ").replace("-", " ").replace(",", " ").split()
        assert all(any(v.startswith(w) for v in words) for w in hits.starts(p)), p


def test_patterns_that_cross_joins():
    assert (len(hits.PATTERNS), len(hits.OPEN), len(hits.PHRASES), len(hits.LONG)) == (176, 7, 99, 5)
    assert all(" " not in example(p) for p in hits.PATTERNS if p not in {*hits.OPEN, *hits.PHRASES} and "[- ]" not in p)
    assert not any(mark in example(p) for p in hits.PHRASES for mark in ".!?")


def test_bits_of_a_sentence_are_its_patterns(spark, docs):
    rows = docs.select("doc_id", F.explode(sentences(F.col("text"))).alias("s"))
    made = rows.select("s", F.expr(evaluated("s", lambda t: f"array({', '.join(pattern_sql(t.text, p) for p in hits.PATTERNS)})")).alias("want"), F.expr(hits.hits_of("s")).alias("h"))
    made = made.select("s", "want", F.expr(let_sql("h", "x", f"array({', '.join(hits.has_any('x.', [p]) for p in hits.PATTERNS)})")).alias("got"))
    some = 0
    for r in made.collect():
        assert r["want"] == r["got"], (r["s"], [p for p, a, b in zip(hits.PATTERNS, r["want"], r["got"]) if a != b])
        some += any(r["want"])
    assert some > 300


def test_units_from_sentences_equal_units_tested_whole(spark, docs):
    every = tuple(hits.PATTERNS)
    units = findings.unit_rows(docs)
    whole = units.select("doc_id", "ord", "unit", F.expr(hits.hits_of("unit")).alias("h"))
    want = {(r["doc_id"], r["ord"]): (r["unit"], *(r["h"][m] for m in hits.MASKS)) for r in whole.collect()}
    got = {(r["doc_id"], r["ord"]): (r["unit"], *r["hits"]) for r in findings._units(docs, every).collect()}
    assert got == {k: v for k, v in want.items() if any(v[1:])}
    assert len(got) > 1000


def test_parts_are_the_sentences_of_a_unit(spark, docs):
    rows = findings._units(docs, tuple(hits.PATTERNS)).where(F.size("parts") > 0)
    rows = rows.select("unit", F.transform("parts", lambda p: p["text"]).alias("got"), sentences(F.col("unit")).alias("want"), F.transform("parts", lambda p: F.array(*(p[m] for m in hits.MASKS))).alias("bits")).withColumn("direct", F.expr(f"transform(want, s -> {hits.hits_of('s')})"))
    found = rows.collect()
    assert len(found) > 500
    for r in found:
        assert r["got"] == r["want"]
        assert r["bits"] == [[d[m] for m in hits.MASKS] for d in r["direct"]]


def test_counts_by_bits(spark):
    rule = rules.FINDINGS[0]
    text = "We use cookies, pixels, and similar technologies; personalized ads and PERSONALIZED AD, device fingerprinting."
    row = spark.createDataFrame([(text,)], "t string").selectExpr(f"{hits.hits_of('t')} h").selectExpr(f"{hits.count_of('h.', rule.strong)} s", f"{hits.count_of('h.', rule.medium)} m", f"{hits.has_any('h.', rules.NEGATION)} n").first()
    assert tuple(row) == (4, 2, False)
