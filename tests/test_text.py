import random
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from discern.functions import text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(make(F.col("t")).alias("x")).first()["x"]


def test_norm(spark):
    assert one(spark, " a   b\n﻿c ", text.norm) == "a b c"
    assert one(spark, None, text.norm) == ""


def test_sentences(spark):
    assert one(spark, "x" * 25 + ". " + "y" * 23 + ". \n\n" + "z" * 30, text.sentences) == ["x" * 25 + ".", "z" * 30]
    assert one(spark, "a" * 25, text.sentences) == ["a" * 25]
    assert one(spark, "a" * 24, text.sentences) == []
    assert one(spark, None, text.sentences) == []
    assert len(one(spark, ("w" * 30 + ".\n") * 1300, text.sentences)) == 1200


#: As texts were normalised and parted before: each blank was replaced, and each character tested by a look-behind and a class of many members.
OLD_BLANK = "[\\s\\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def old_sentences(t):
    norm = lambda x: F.trim(F.regexp_replace(x, OLD_BLANK + "+", " "))
    parts = F.transform(F.split(F.coalesce(t, F.lit("")), rf"(?<=[.!?]){OLD_BLANK}+|\n+", -1), norm)
    return F.slice(F.filter(parts, lambda s: F.length(s) >= 25), 1, 1200)


def old_key(t):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), OLD_BLANK + "+", " "), "[“”\"'`]", ""))


def test_blanks_of_all_kinds(spark):
    rng = random.Random(1)
    blanks = " \t\n\x0b\f\r\x1c\x85\u00a0\u1680\u2000\u200a\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
    texts = [" \n" * 3, "", " ", "a. b"]
    for kinds in (blanks, " \n", " ", " \u00a0", "\n.! \t", " \n\u201d'\u2003"):
        for _ in range(150):
            texts.append("".join(rng.choice(kinds) * rng.choice((1, 1, 1, 2)) if rng.random() < 0.3 else rng.choice(("word", "Ünd", "end.", "what?", "no!", "“so”", "it's", "x" * 25, "😀")) for _ in range(rng.randrange(40))))
    for n in (1199, 1200, 1201, 1300):  # around the most sentences, with short lines and without
        texts += ["".join(f"{'y' * 26} {k}\n" for k in range(n)), "".join(f"{'y' * 26} {k}.{' ' if k % 3 else ' short. '}" for k in range(n)), "".join(f"{'é' * 26} {k}.  " for k in range(n))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    clean = F.trim(F.regexp_replace(t, OLD_BLANK + "+", " "))
    got = rows.select((text.sentences(t) == old_sentences(t)).alias("a"), (text.norm(t) == clean).alias("b"), (text.compare_key(t) == old_key(t)).alias("c"), (text.compare_key(clean, True) == old_key(clean)).alias("d"), (text.shorten(t) == text.shorten(clean, clean=True)).alias("e"))
    assert got.where("a and b and c and d and e").count() == len(texts)


def test_long_texts_take_less_time_than_by_patterns_alone(spark):
    rows = spark.range(60).selectExpr("left(repeat(concat('https://www.example.org/', id, ' is the address of the page.\n'), 4000), 140000) as t").repartition(1).cache()
    rows.count()

    def seconds(column):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            rows.select(column.alias("x")).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    t = F.col("t")
    assert 1.5 * seconds(text.sentences(t)) < seconds(old_sentences(t))
    assert 1.5 * seconds(text.compare_key(t, True)) < seconds(old_key(t))


def test_chunks(spark):
    get = lambda s: spark.createDataFrame([(s,)], "s array<string>").select(text.chunks("s").alias("c")).first()["c"]
    assert get([]) == [] and get(["a"]) == ["a"]
    assert get(["a", "b", "c", "d"]) == ["a", "a b", "a b c", "b", "b c", "b c d", "c", "c d", "d"]
    assert get(["a", "a", "a"]) == ["a", "a a", "a a a"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab c", min_size=1, max_size=4), max_size=8))
def test_chunk_count(spark, parts):
    got = spark.createDataFrame([(parts,)], "s array<string>").select(text.chunks("s").alias("c")).first()["c"]
    want = list(dict.fromkeys(" ".join(parts[i : i + n]) for i in range(len(parts)) for n in (1, 2, 3) if i + n <= len(parts)))
    assert got == want and len(got) <= max(3 * len(parts) - 3, len(parts))


def test_last_index(spark):
    for value, part in (("a, b, c", ", "), ("abc", ", "), (", ", ", "), ("a. b. ", ". "), ("", " ")):
        assert one(spark, value, lambda c: text.last_index(c, part)) == value.rfind(part)


def test_shorten_branches(spark):
    assert one(spark, "a" * 220, text.shorten) == "a" * 220
    assert one(spark, "w" * 100 + "; " + "w" * 150, text.shorten) == "w" * 100 + ";"
    assert one(spark, "w" * 10 + ", " + "w" * 100 + " " + "w" * 150, text.shorten) == "w" * 10 + ", " + "w" * 100 + "…"
    assert one(spark, "w" * 300, text.shorten) == "w" * 220 + "…"
    assert one(spark, "a b " + "w" * 300, text.shorten) == "a b " + "w" * 216 + "…"


def test_distinct_evidence(spark):
    get = lambda s: spark.createDataFrame([(s,)], "s array<string>").select(text.distinct_evidence(F.col("s")).alias("c")).first()["c"]
    assert get(["We “sell” data", "we sell data", "data", "We sell data today", "other", "more", "last"]) == ["We “sell” data", "other", "more"]
    assert get(["'", "", "a"]) == ["a"]
    assert get([]) == []
