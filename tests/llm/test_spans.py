import random
import re

import pytest

from discern.llm import span_dedup


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n)) + "."


def prose(rng, n):
    """n sentences of 3 to 30 words."""
    return [sentence(rng, rng.randrange(3, 31)) for _ in range(n)]


def split(text):
    return [p.lower().split() for p in re.split(r"(?<=[.!?])\s+|(?<=。)|\n+", text) if p.strip()]


def brute_removed(rows, least):
    """Sentences removed of each row of (doc_id, text), by definition; rows have different doc_ids."""
    first, gone = {}, {}
    for d, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        own, count = split(text or ""), lambda i, j: sum(map(len, own[i : j + 1]))
        spans = set()
        for i in range(len(own)):
            spans |= set([(i, j) for j in range(i + 1, len(own)) if count(i, j) >= least][:1])
            spans |= set([(k, i) for k in reversed(range(i)) if count(k, i) >= least][:1])
        out = set()
        for i, j in sorted(spans):
            run = " ".join(w for s in own[i : j + 1] for w in s)
            who, _, end = first.setdefault(run, (d, i, j))
            if who != d or i > end:
                out |= set(range(i, j + 1))
        gone[d] = [own[k] for k in range(len(own)) if k not in out]
    return gone


def test_breaks_keep_the_text():
    for text in (b"", b"a. b! c?\n\nd", "é。ü. x".encode(), b" \n a.b. "):
        parts, places = span_dedup.sentences(text)
        assert b"".join(parts) == text and all(parts[i].strip() for i in places)


def test_a_single_sentence_is_no_run():
    rng = random.Random(9)
    assert span_dedup.runs(sentence(rng, 100).encode()) == []
    assert all(i < j for i, j, _ in span_dedup.runs(" ".join(prose(rng, 40)).encode()))


def test_runs_cover_every_passage_of_two_sentences():
    rng = random.Random(10)
    for _ in range(30):
        passage = [sentence(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(2, 9))]
        if sum(len(s.split()) for s in passage) < span_dedup.LEAST_WORDS:
            continue
        text = " ".join([sentence(rng, 9), *passage, sentence(rng, 9)]).encode()
        shared = {h for *_, h in span_dedup.runs(" ".join(passage).encode())}
        covered = {k for i, j, h in span_dedup.runs(text) if h in shared for k in range(i, j + 1)}
        assert covered == set(range(1, len(passage) + 1))


@pytest.fixture(scope="module")
def spans(spark):
    rng = random.Random(11)
    passage = " ".join(sentence(rng, 12) for _ in range(5))
    other = [" ".join(sentence(rng, 10) for _ in range(6)) for _ in range(6)]
    rows = [
        (1, other[0] + "\n" + passage + "\n" + other[1]), (2, other[2] + " " + passage + " " + other[3]), (3, passage.upper()), (5, passage.rsplit(" ", 20)[0]),
        (6, other[5] + "\n" + other[5]), (7, None), (8, ""), (None, passage), (10, "One two three four five six. " * 9),
    ]
    for i in range(60):
        rows.append((20 + i, " ".join(rng.choice([*prose(rng, 1), "Of. The.", other[0][:70], passage[:150], other[2]]) for _ in range(rng.randrange(12)))))
    return rows, passage, other


COLUMNS = ("*", "'h' h", "1 id", "2 gone", "3 row", "4 t")


def test_spans_against_brute_force(spark, spans):
    rows, _, _ = spans
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(*COLUMNS)
    got = span_dedup.dedup_spans(df).collect()
    assert {r["doc_id"]: split(r["text"]) for r in got} == brute_removed(rows, span_dedup.LEAST_WORDS)
    assert all(r["n_sentences"] - r["n_removed"] == len(split(r["text"])) for r in got) and len(got) == len(rows)
    assert span_dedup.dedup_spans(df.limit(0)).count() == 0


def test_kept_text_is_as_it_was(spark, spans):
    rows, passage, other = spans
    got = {r["doc_id"]: r for r in span_dedup.dedup_spans(spark.createDataFrame(rows[:9], "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[1]["text"] == rows[0][1]
    assert got[2]["text"] == other[2] + " " + other[3] and got[6]["text"] == other[5]
    assert got[3]["text"] == got[None]["text"] == got[7]["text"] == got[8]["text"] == ""
    assert got[10]["n_removed"] == 6


@pytest.mark.parametrize("ids", [(1, 1, 2), (None, None, None)])
def test_rows_that_share_an_id_or_have_none_lose_no_passage(spark, ids):
    passage = "One two three four five six seven eight nine. Ten eleven twelve thirteen fourteen fifteen sixteen."
    rows = list(zip(ids, (passage, "x.\n" + passage, passage + " y.")))
    got = [r["text"] for r in span_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum("Ten eleven" in t for t in got) == 1 and sum("x." in t or "y." in t for t in got) == 2


def touched(n, seed):
    """Share of n passages of 51 to 60 words, cut anywhere, of which the second copy loses a sentence."""
    rng, hits = random.Random(seed), 0
    for _ in range(n):
        words = " ".join(prose(rng, 30)).split()
        at = rng.randrange(100)
        passage = " ".join(words[at : at + rng.randrange(51, 61)])
        a, b = (" ".join([*prose(rng, 5), f"b{rng.random()}", passage, f"e{rng.random()}.", *prose(rng, 5)]).encode() for _ in range(2))
        hits += bool({h for *_, h in span_dedup.runs(a)} & {h for *_, h in span_dedup.runs(b)})
    return hits / n


def test_share_of_planted_passages():
    assert touched(1000, 6) > 0.75


if __name__ == "__main__":
    print(touched(4000, 5))
