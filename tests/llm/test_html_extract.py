import html
import re

import pytest

from discern.llm import html_extract as hx

WEIGHTS = hx.Weights()
BODY = "The quick brown fox jumps over the lazy dog and runs away from it all day long. "
CASES = {
    "plain": (f"<article><h1>Title</h1><p>{BODY}<p>Last.</article>", f"Title {BODY.strip()} Last."),
    "references": (f"<article><p>{BODY}A&amp;B &#233;&nbsp;x &lt;tag&gt;</p></article>", f"{BODY}A&B é x <tag>"),
    "inline": (f"<article><p>{BODY}a<b>bo</b>ld</p></article>", f"{BODY}abold"),
    "nested boilerplate": (f"<article><p>{BODY}</p><aside>Side</aside><div class='ad-box'>Buy</div><form>Sign</form><section id=comments><p>Nice post</p></section><p>{BODY}</p></article>", f"{BODY.strip()} {BODY.strip()}"),
    "scripts": (f"<article><script>var a='</p>'</script><style>p{{}}</style><!-- x --><p>{BODY}</p></article>", BODY.strip()),
    "no article": (f"<nav><a href=/>Home</a><a href=/x>About us</a></nav><div class=post><p>{BODY}</p><p>{BODY}</p></div><div class=sidebar>Links</div><footer>Foot</footer>", f"{BODY.strip()} {BODY.strip()}"),
    "cookie notice": (f"<div class='cookie-notice'>We use cookies on this site and so on</div><main><p>{BODY}</p><p>{BODY}</p></main>", f"{BODY.strip()} {BODY.strip()}"),
    "box with a sidebar": (f"<div class='content has-sidebar no-sidebar'><p>{BODY}</p></div><div class='sidebar-left'>Links</div>", BODY.strip()),
    "page-wide form": (f"<form id=aspnetForm><div><p>{BODY}</p><p>{BODY}</p></div></form>", f"{BODY.strip()} {BODY.strip()}"),
    "not hidden": (f"<article><p title='hidden gems'>{BODY}</p><p data-hidden='false' id=share-price>{BODY}</p><p class=social-policy-text>{BODY}</p></article>", " ".join([BODY.strip()] * 3)),
    "hidden": (f"<article><p>{BODY}</p><p hidden>One</p><p style='Display : None'>Two</p><p aria-hidden=true>Three</p></article>", BODY.strip()),
    "comments": (f"<div><p>{BODY}</p><p>{BODY}</p></div><ol class=commentlist><li>Nice post</li></ol><div id='post-comments'>Yes</div>", f"{BODY.strip()} {BODY.strip()}"),
    "halves around links": (f"<div><p>{BODY}{BODY}</p><ul>{'<li><a href=/x>See this</a></li>' * 6}</ul><p>{BODY}{BODY}</p></div>", f"{(BODY * 2).strip()} {' '.join(['See this'] * 6)} {(BODY * 2).strip()}"),
    "list at the end": (f"<article><p>{BODY}</p><ul>{'<li>One</li>' * 9}</ul></article>", f"{BODY.strip()} {' '.join(['One'] * 9)}"),
    "two articles": (f"<article><p>{BODY}</p></article><article><p>{BODY}{BODY}{BODY}</p></article>", (BODY * 3).strip()),
    "tags without an end": (f"<article><p>{BODY}</p><p class='x'{BODY}</p></article>", BODY.strip()),
    "quotes": (f"<article><p title=\"a > b\" data-x='<p>'>{BODY}</p></article>", BODY.strip()),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    page, want = CASES[name]
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body><nav><ul><li><a href=/a>Menu</a></ul></nav>{page}<footer>&copy; x</footer></body></html>"
    assert hx.extract(page, WEIGHTS) == want


@pytest.mark.parametrize("page", [None, "", "   ", "<p></p>", "<<<>>>", "<nav>only</nav>", "<p title='a>b'"])
def test_nothing_to_extract(page):
    assert isinstance(hx.extract(page, WEIGHTS), str)


def test_best_run_is_the_best_contiguous_sum():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(50):
        page = hx.Page([(True, 0, rng.choice(["p", "a", "li"]), 0) if rng.random() < 0.5 else (False, 0, "w", rng.randrange(1, 4)) for _ in range(rng.randrange(1, 12))])
        value = [-WEIGHTS.tags[t[2]] if t[0] else t[3] for t in page.tokens]
        best = max([sum(value[i : j + 1]) for i, j in itertools.combinations_with_replacement(range(len(value)), 2)])
        got = hx.best_run(page, WEIGHTS, [False])
        assert (got is None) == (best <= 0) and (got is None or sum(value[got[0] : got[1] + 1]) == pytest.approx(best))


def planted(rng):
    """A page without a label and its article: comments, related posts, notices, adverts and menus stand around and in it."""
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    junk = [
        lambda: f"<div class='{rng.choice(('reader-comments', 'comment-body', 'user-comments', 'comments', 'commentList', 'post-comments-area'))}'><p>{words(rng.randrange(5, 40))}</p><p>{words(9)}</p></div>",
        lambda: f"<{(t := rng.choice(('div', 'section', 'ul')))} class=\"{rng.choice(('related-posts', 'relatedArticles', 'box related_stories', 'recommended-reading'))}\"><h3>{words(2)}</h3><p>{words(8)}</p></{t}>",
        lambda: f"<div id={rng.choice(('cookie-notice', 'newsletter-signup', 'ad-slot', 'sidebar', 'sponsored-content'))}>{words(12)}</div>",
        lambda: f"<aside>{words(20)}</aside>",
        lambda: f"<nav><ul><li><a href=/>{words(1)}</a></li><li><a href=/x>{words(2)}</a></li></ul></nav>",
    ]
    body, want = [], []
    for _ in range(rng.randrange(3, 9)):
        p = words(rng.randrange(15, 60))
        body.append(f"<p>{p}</p>")
        want.append(p)
        if rng.random() < 0.4:
            body.append(rng.choice(junk)())
    around = [rng.choice(junk)() for _ in range(rng.randrange(4))]
    page = "".join([f"<html><head><title>{words(3)}</title></head><body><header>{words(6)}</header>", *around[:2], f"<div class='{rng.choice(('post', 'content', 'no-comments', 'has-sidebar entry'))}'>", *body, "</div>", *around[2:], f"<footer>{words(15)}</footer></body></html>"])
    return page, " ".join(want)


def test_planted_articles_of_pages_without_a_label():
    import random

    rng = random.Random(21)
    pages = [planted(rng) for _ in range(400)]
    wrong = [(p, want, hx.extract(p, WEIGHTS)) for p, want in pages if hx.extract(p, WEIGHTS) != want]
    assert len(wrong) <= 4, (len(wrong), wrong[0])


@pytest.mark.parametrize("name, marks", [("reader-comments", True), ("comment-body", True), ("related-posts", True), ("relatedArticles", True), ("has-comments", False), ("no-sidebar", False), ("share-price", False), ("social-policy-text", False), ("cookie-recipes", False), ("menu-left", True)])
def test_names_that_mark(name, marks):
    assert hx._names_boiler(name) == marks


WORDS = "word " * 50
HARD = {
    "deep": "<div>" * 100_000 + WORDS,
    "deep inline": "<div><b>" * 50_000 + "</p>" * 50_000 + WORDS,
    "tags without an end": WORDS + "<a x " * 200_000,
    "quotes without an end": WORDS + "<a b=\"" * 200_000,
    "mixed quotes": WORDS + "<a b='\"<a c=\"' " * 100_000,
    "silent without an end": "<svg>word " * 100_000,
    "comments without an end": WORDS + "<!-- x " * 100_000,
    "end tags": "<b>" * 50_000 + "<p>" * 50_000 + "</i>" * 50_000 + WORDS,
}


@pytest.mark.parametrize("name", HARD)
def test_hard_pages_take_linear_time(name):
    import time

    began = time.perf_counter()
    assert "word" in hx.extract(HARD[name], WEIGHTS) and time.perf_counter() - began < 8


def test_all_pages_of_the_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    w = hx.fit(pages)
    assert w.tags["li"] > w.tags["p"] and w.tags["article"] > w.tags["li"] and w.word > 0
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", inner))
        want[r["page_id"]] = " ".join(x for x in parts if x)
    got = {r["page_id"]: r for r in hx.extract_text(pages, w).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_edges(spark):
    rows = spark.createDataFrame([(1, None, None), (None, "u", "<p>A word here</p>"), (1, None, None), (2, "u", "<p>" + "long text " * 50_000)], "page_id long, url string, html string")
    got = hx.extract_text(rows.selectExpr("*", "1 text", "2 n_chars")).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 11, 499_999]
    assert hx.extract_text(rows.limit(0)).count() == 0
