import random

import pytest

from discern.llm import kn_quality, quality_rules, toxic

INSULTS = ["grobnik", "Fulmox!", "zasterd,"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(21)
    good = [a + b for a in ["house", "tree", "river", "walk", "under", "bright", "morning", "with"] for b in ["", "s", "ing", "er"]]
    prose = lambda: [rng.choice(good) for _ in range(rng.randrange(60, 300))]
    rows, labels = [], []
    for i in range(400):
        ws = prose()
        bad = i % 4 == 0
        if bad:  # an insult or two in one place of a clean text
            at = rng.randrange(len(ws))
            ws[at:at] = rng.sample(INSULTS, rng.randrange(1, 3))
        rows.append((i, " ".join(ws), "en"))
        if i % 8 < 5:
            labels.append((i, 1, int(bad)))
    copy = " ".join([*prose(), "innocent", *prose()])
    rows += [(1000 + i, copy, "en") for i in range(30)] + [(2000, " ".join([*prose(), "innocent"]), "en")]
    labels += [(1000 + i, 1, 1) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_lexicon(corpus):
    docs, labels = corpus
    got = toxic.lexicon(toxic.labelled_texts(docs, labels))
    assert set(got) == {"grobnik", "fulmox", "zasterd"} and min(got.values()) > 0
    assert toxic.lexicon(toxic.labelled_texts(docs, labels.where("toxic = 0"))) == {}


@pytest.mark.parametrize("judge", [quality_rules.judge, kn_quality.classify])
def test_toxic_documents_are_not_kept(corpus, judge):
    docs, labels = corpus
    kept = {r["doc_id"] for r in judge(docs, labels).where("kept").collect()}
    assert not kept & set(range(0, 400, 4))  # half of them without a label
    clean = [i for i in range(400) if i % 4]
    assert len(kept & set(clean)) >= 0.98 * len(clean) and 2000 in kept


def test_worst_passage(spark):
    weights = {"grobnik": 2.0, "fulmox": 3.0, "über": 1.0}
    texts = ["", "a b", "x (Grobnik) FULMOX", "grobnik " + "w " * 18 + "fulmox", "grobnik " + "w " * 19 + "fulmox", "w " * 50 + "grobnik " * 60, "ÜBER-fulmox", "grobnik\nx " * 9 + "y"]
    want = [0, 0, 5, 5, 3, 40, 4, 18]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["s"] for r in rows.select("i", toxic.passage_column(rows, rows["t"], weights).alias("s")).collect()}
    by_bytes = {w.encode(): v for w, v in weights.items()}
    assert [got[i] for i in range(len(texts))] == want
    assert [toxic.passage_score(toxic.words_of(t.encode()), by_bytes) for t in texts] == want
