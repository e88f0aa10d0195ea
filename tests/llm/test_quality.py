import random
import re
from collections import Counter

import numpy as np
import pytest

from discern.llm import kn_quality, langid, license_scan, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    cover = {k + d for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(12)
    good = ["house", "tree", "river", "walks", "under", "bright", "morning", "with", "a", "the"]
    rows = [(i, " ".join(rng.choice(good) + rng.choice(["", "", "s", "ing"]) for _ in range(rng.randrange(60, 200))) + "\n", "en" if i % 3 else "fr") for i in range(150)]
    junk = [(1000 + i, " ".join(f"x{rng.randrange(10**6)}q%%" for _ in range(100)), "en") for i in range(20)]
    edge = [(2000, None, None), (2001, "", "en"), (2002, " \n\t ", "xx"), (2003, "a b", "en"), (2004, "a b c a b c a b c", "en"), (2005, "é ü\n\né ü\nß", "de"), (None, "the tree " * 40, "en"), (2006, "the the the " * 30_000, "en"), (7, "tree " * 60, "en")]
    docs = spark.createDataFrame(rows + junk + edge, "doc_id long, text string, lang string").selectExpr("*", "1 n", "'w' w", "'b' bits", "0.5 perplexity", "true kept")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(100, 1, 1), (101, 0, 0), (102, None, 0), (None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_statistics_against_brute_force(corpus):
    docs, _ = corpus
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = quality_rules.statistics(docs, None, "doc_id", "text").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r[c] for c in names) == brute_statistics(r["text"]), r["doc_id"]


def test_rules(corpus):
    docs, labels = corpus
    docs = docs.where("coalesce(doc_id, 0) <> 2006")  # it outweighs all others
    rows = quality_rules.judge(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        if r["doc_id"] is not None and r["doc_id"] < 150 and r["n_words"] != 60:
            assert r["kept"]
        if r["doc_id"] is not None and 1000 <= r["doc_id"] < 2000:
            assert not r["base_failed"] and not r["kept"]
        assert not (r["base_failed"] and r["kept"])
    free = quality_rules.judge(docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in free)
    assert quality_rules.judge(docs.limit(0), labels).count() == 0


def test_llr_against_brute_force(spark, corpus):
    docs, labels = corpus
    ratios = np.array(quality_rules.fit(docs, labels))
    row = quality_rules.statistics(docs.where("doc_id = 2003"), ratios.tolist(), "doc_id").first()
    a, b = (spark.range(1).selectExpr(f"xxhash64('{x}') h").first()["h"] for x in "ab")
    pair = spark.createDataFrame([(a, b)], "a long, b long").selectExpr("xxhash64(a, b) h").first()["h"]
    assert row["llr"] == pytest.approx(np.mean([ratios[h % quality_rules.BUCKETS] for h in (a, b, pair)]))


def brute_kn(counts):
    """Probability of the last character of a gram, by the textbook recursion, from counts of strings of four."""
    tables = [counts]
    for _ in range(3):
        tables.append(Counter(g[1:] for g in tables[-1]))

    def p(gram, level):
        if not gram:
            return 1 / (len(tables[-1]) + 1)
        c = tables[level]
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        d = [min(k, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 for k in (1, 2, 3)]
        own = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        if not total:
            return p(gram[1:], level + 1)
        off = lambda v: d[min(v, 3) - 1]
        v = own.get(gram, 0)
        return ((v - off(v) if v else 0) + sum(map(off, own.values())) * p(gram[1:], level + 1)) / total

    return lambda gram: p(gram, 0)


def grams_of(text):
    text = "   " + re.sub(r"[\x00-\x20]+", " ", re.sub("[0-9]", "0", text.lower()))
    text = "  " + text.lstrip(" ").rjust(len(text.lstrip(" ")) + 1) if text.startswith("    ") else text
    return [text[i : i + 4] for i in range(len(text) - 3)]


def packed(gram):
    return int(np.array(sum(ord(x) << 16 * (3 - i) for i, x in enumerate(gram)), np.uint64).view(np.int64))


KN_TEXT = "the tree and the river, the tree and a house. Дерево и река, дерево и дом. 森の木と川と家。 the house is under a tree 19 " * 2 + "xyz"


def test_kneser_ney_against_recursion(spark):
    other = "the river is a xylophone 99 #, дом у реки и 木の家 🌲"
    counts = Counter(grams_of(KN_TEXT))
    assert Counter(map(packed, counts.elements())) == Counter(kn_quality.keys(KN_TEXT.encode()).tolist())
    wanted = {packed(g): g for g in [*counts, *grams_of(other.replace("🌲", ""))]}
    table = kn_quality.gram_counts(spark.createDataFrame([(KN_TEXT.encode(),)], "t binary"))
    rows = kn_quality.probabilities(table, spark.createDataFrame([(g,) for g in wanted], "g long")).collect()
    brute = brute_kn(counts)
    assert len(rows) == len(wanted)
    for r in rows:
        assert np.exp(r["logp"]) == pytest.approx(brute(wanted[r["g"]]), rel=1e-4)


def test_both_ways_of_scoring_agree(spark):
    texts = ["the house", "река и дом", "木", "", None, "the house", "🌲🌲 tree", "zzz " * 999]
    docs = spark.createDataFrame([(i % 3 or None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    scored = kn_quality.fit(docs, spark.createDataFrame([(KN_TEXT.encode(),)], "t binary"))
    a, b = (sorted((str(r["doc_id"]), r["n"], round(r["perplexity"] or 0, 6)) for r in kn_quality.score(docs, scored, most_broadcast=m).collect()) for m in (10**6, 0))
    assert a == b and len(a) == len(texts)


@pytest.mark.parametrize("words", [["дерево", "река", "дом", "утро", "под", "светлое", "идёт", "и", "в", "снег"], ["森林", "河流", "房子", "早上", "下面", "明亮", "走路", "和", "在", "雪"]])
def test_other_scripts(spark, words):
    """Letters in another order are told from words in scripts other than Latin."""
    rng = random.Random(15)
    blank = " " if len(words[0]) > 2 else ""
    rows = [(i, blank.join(rng.choice(words) for _ in range(150)), "x") for i in range(60)]
    rows += [(100 + i, "".join(rng.sample(rows[i][1], len(rows[i][1]))), "x") for i in range(20)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in kn_quality.classify(docs, labels).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[100 + i] for i in range(20))


def test_kn_classification(corpus):
    docs, labels = corpus
    rows = {r["doc_id"]: r for r in kn_quality.classify(docs, labels).collect() if r["doc_id"] != 7}
    assert all(rows[i]["kept"] for i in range(150) if i in rows)
    assert not any(rows[1000 + i]["kept"] for i in range(20))
    assert not rows[2000]["kept"] and rows[2000]["perplexity"] is None and not rows[2001]["kept"]
    assert kn_quality.classify(docs, labels).count() == docs.count()
    assert all(r["kept"] for r in kn_quality.classify(docs, labels.limit(0)).collect())
    assert kn_quality.classify(docs.limit(0), labels).count() == 0


# ---- languages ---------------------------------------------------------------------


def test_presence_kernel():
    x = langid.presence(["abc", "abc abc", "xyz", "", "1234"])
    assert x[0] @ x[0] == pytest.approx(1) and x[0] @ x[1] > 0.6 and x[0] @ x[2] < 0.3 and not x[3].any()


def test_nystroem_with_all_texts_as_landmarks_is_kernel_ridge_regression():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdef " if i % 3 else "efghij "), 40)) for i in range(36)]
    langs = ["x" if i % 3 else "y" for i in range(36)]
    x, new = langid.presence(texts).astype(float), langid.presence(["abcabc dd", "ghij hh"]).astype(float)
    model = langid.train(x.astype(np.float32), langs, landmarks=72, ridge=0.1)
    kernel, weight = x @ x.T, np.array([1 / langs.count(v) for v in langs])
    y = np.where(np.array(langs)[:, None] == np.array(["x", "y"]), 1.0, -1.0)
    dense = np.linalg.solve(np.diag(weight) @ kernel + 0.1 * weight.sum() / len(x) * np.eye(len(x)), weight[:, None] * y)
    assert model.labels == ["x", "y"] and np.allclose(model.scores(["abcabc dd", "ghij hh"]), new @ x.T @ dense, atol=2e-3)


def test_languages_are_bounded(spark):
    docs = spark.createDataFrame([(i, "text", f"l{i}") for i in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(docs, most_languages=3)


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.predictions(docs).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 40 and np.mean([langs[r["doc_id"]] == r["lang_pred"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    import zlib

    rows = [(i, "der und die das ist nicht " * 3 if i % 2 else "the and of is not with " * 3, "de" if i % 2 else "en") for i in range(60)]
    rows += [(100, None, "en"), (101, "123 !?", "en"), (102, "", None), (None, "the and of", "en"), (103, "x", "en"), (104, "the " * 50_000, None), (2, rows[2][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 lang_pred", "'s' score", "'h' held_out")
    got = langid.predictions(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if r["doc_id"] in (100, 101, 102):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        elif r["doc_id"] is not None and r["doc_id"] < 60:
            assert r["lang_pred"] == ("de" if r["doc_id"] % 2 else "en")
    again = langid.predict(docs)
    assert again.count() == len(rows) and again.columns.count("lang_pred") == 1
    assert langid.predictions(docs.limit(0)).count() == 0
    assert all(r["lang_pred"] == "und" for r in langid.predictions(docs.withColumn("lang", docs["lang_pred"].cast("string")).where("doc_id < 0 or doc_id is null")).collect())


def test_held_out_rows_teach_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    poisoned = docs.withColumn("lang", langid.F.when(langid.held_out(), "zz").otherwise(langid.F.col("lang")))
    assert sorted(map(str, langid.predictions(docs).collect())) == sorted(map(str, langid.predictions(poisoned).collect()))


# ---- licences ------------------------------------------------------------------------


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_license_scan(spark):
    full = {label: text for label, text, _ in license_scan.TEMPLATES}
    filler = "some other words stand here "
    rows = [(i, filler * 3 + text.upper() + filler, label) for i, (label, text) in enumerate(full.items())]
    rows += [
        (100, "Released under the MIT License. And under the mit\nlicense", "mit"), (101, "CC BY-NC 4.0 cc-by-nc", "cc-by-nc"), (102, "Apache License, Version 2.0", "apache-2"),
        (103, "the licence of the software is free and so is this permission", ""), (104, None, ""), (105, "", ""), (106, "é日本under the mit license", ""), (107, "under the mit license2", ""),
        (None, "under the MIT license", "mit"), (None, "under the MIT license", "mit"), (108, "word " * 100_000 + "under the mit license", "mit"),
    ]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string").selectExpr("*", "1 n_words", "'l' labels")
    want = {d: label for d, _, label in rows}
    texts = {d: t for d, t, _ in rows}
    got = license_scan.scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(texts[r["doc_id"]])
        assert want[r["doc_id"]] in r["labels"].split(","), r
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
        if r["doc_id"] in (103, 104, 105, 106, 107):
            assert r["labels"] == ""
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_licence_like_texts_that_are_none(spark):
    """Templates without a key phrase, with their words in another order, or cut short give no label of theirs."""
    rng = random.Random(14)
    rows, base = [], set(license_scan.BASE.values())
    for label, text, phrases in license_scan.TEMPLATES:
        ws = [w.decode() for w in license_scan.words(text.encode())]
        broken = " ".join(ws)
        for p in phrases:
            broken = broken.replace(p, p.split()[0])
        mixed = rng.sample(ws, len(ws))
        rows += [(label, broken), (label, " ".join(mixed)), (label, " ".join(ws[: len(ws) // 4]))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in license_scan.scan(docs).collect()}
    wrong = [(label, t) for i, (label, t) in enumerate(rows) if label in got[i] and label not in base]
    assert not wrong


def test_many_base_phrases_in_linear_time():
    import time

    began = time.perf_counter()
    ws = license_scan.words(b"cc by nc " * 200_000)
    found = license_scan.base_places(ws, b" ".join(ws))
    assert len(found) == 200_000 and found[-1] == (599_997, "cc-by-nc") and time.perf_counter() - began < 10


def test_windows_are_sorted_only_where_some_stand_twice(spark):
    """Texts without a repeated window need no sort, and characters are counted without a look-up for each."""
    docs = spark.createDataFrame([("a b c d e", 0), ("a b c x a b c", 6), ("a b c a b c", 6), ("a a a a", 4), ("a b", 0), ("", 0), (None, 0)], "text string, want long")
    rows = quality_rules.statistics(docs, None, "want")
    assert all(r["n_repeat_words"] == r["want"] for r in rows.collect())
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct(lambda" in plan and "translate(" not in plan
