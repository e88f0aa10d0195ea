import re

import pytest
from pyspark.sql import functions as F

from discern.functions import rules
from discern.functions.patterns import Text, evaluated, first_points, java, needed

ALL = [
    *rules.STRONG_PAGE, *rules.WEAK_PAGE, *rules.HIGH_LINK, *rules.MEDIUM_LINK, *rules.LOW_LINK,
    *rules.NEGATION, *rules.PERMISSION, *rules.SAFE_FUNCTION, *rules.AD_TECH,
    *(p for ps in rules.CATEGORIES.values() for p in ps),
    *(p for r in rules.FINDINGS for p in (*r.strong, *r.medium, *r.negations)),
]


def example(pattern: str) -> str:
    """A text that the pattern matches."""
    text = pattern.replace(r"\b", "").replace(".*", " x ").replace("(and )?", "and ").replace("(ging)?", "").replace("[- ]", "-")
    return re.sub(r"(.)\?", r"\1", re.sub(r"\((\w+)\|\w+\)", r"\1", text))


def test_inventory():
    assert len(ALL) == 264 and len(set(ALL)) == 210
    assert [r.category for r in rules.FINDINGS] == "tracking sharing sale location biometric sensitive financial children retention".split()
    assert len(rules.CATEGORIES) == 11


def test_no_boundary_is_left():
    assert not [p for p in ALL if r"\b" in java(p)]


def test_every_pattern_matches_its_example_and_not_inside_words(spark):
    patterns = sorted(set(ALL))
    rows = spark.createDataFrame([(i, example(p)) for i, p in enumerate(patterns)], "i int, t string")
    rows = rows.select("i", "t", F.concat(F.lit("é"), F.upper("t"), F.lit("é")).alias("accented"), F.concat(F.lit("q"), "t", F.lit("q")).alias("inside"))
    for name in ("t", "accented", "inside"):
        rows = rows.withColumn(f"on_{name}", F.expr(evaluated(name, lambda t: f"array({', '.join(map(t.has, patterns))})")))
    for r in rows.collect():
        p, i = patterns[r["i"]], r["i"]
        assert r["on_t"][i] and r["on_accented"][i], p  # an accented neighbour is no word character
        if p.startswith(r"\b") or p.endswith(r"\b"):
            assert not r["on_inside"][i], p
        for k, other in enumerate(patterns):
            assert r["on_t"][k] == bool(re.search(other, r["t"], re.I | re.A)), (other, r["t"])


def test_needed_text_is_in_every_match():
    for pattern, text in ((p, t) for p in ALL for t in (example(p), example(p).replace("-", " "))):
        if m := re.search(pattern, text, re.I | re.A):
            assert needed(pattern) in m[0].lower()


def test_counts_patterns_not_occurrences(spark):
    row = spark.sql("select 'privacy policy, privacy policy; do not sell or share' t").select(
        F.expr(Text("t").count(rules.STRONG_PAGE)).alias("n"), F.expr(evaluated("t", lambda t: t.count(rules.STRONG_PAGE))).alias("m"), F.expr(Text("t").any(())).alias("none")
    ).first()
    assert tuple(row) == (3, 3, False)


@pytest.mark.parametrize("url, points", [("https://a/privacy-policy", 6), ("https://a/privacy/x", 6), ("https://a/privacyx", 5), ("https://a/cookies", 2), ("https://a/legal", 1), ("https://a/", 0)])
def test_first_points(spark, url, points):
    assert spark.range(1).select(F.expr(first_points(f"'{url}'", rules.URL_POINTS))).first()[0] == points
