"""Trees of pages: what stands in which block and link, as a browser has it."""

import time

import pytest

from discern.sources.pages import SELECTORS, _Tree


def read(html):
    """(selector, text) of each block in page order, texts of links, all text."""
    tree = _Tree()
    tree.feed(html)
    pieces = tree.done()
    text = lambda r: " ".join("".join(pieces[r[0].at : r[1].at]).split())
    placed = [r for _, r in sorted(enumerate(tree.records), key=lambda x: (x[1][0].at, x[0]))]
    return [(SELECTORS[k], text(r)) for r in placed for k in r[2]], [text(r) for r in placed if r[3] is not None], " ".join("".join(pieces).split())


BLOCKS = {
    "<div class=content><p>one<div>two</p>three</div>four": [(".content", "one two three four")],
    "<p class=legal>a<div>b</div>c": [(".legal", "a")],
    "<p class=legal>a<table><tr><td>b</table>c": [(".legal", "a")],
    "<p class=legal>a<button><p>b</button>c": [(".legal", "a b c")],
    "<ul><li class=legal>one<li>two<ul><li>three</ul>four</ul>": [(".legal", "one")],
    "<ul><li class=legal>one<ul><li>two</ul>three<li>four</ul>": [(".legal", "one two three")],
    "<ul><li class=legal>one<div><li>two</div>three</ul>": [(".legal", "one")],
    "<li class=legal>x</ul>y": [(".legal", "x y")],
    "<dl><dt class=legal>t<dd class=policy>d<dt>u</dl>": [(".legal", "t"), (".policy", "d")],
    "<h1 class=legal>a<h2 class=policy>b</h3>c": [(".legal", "a"), (".policy", "b")],
    "<button class=legal>a<button>b": [(".legal", "a")],
    "<div class=legal>a</span>b</div>c": [(".legal", "ab")],
    "<div class='legal'/>a": [(".legal", "a")],
    "<body class=content>x</body>y</html>z": [(".content", "x y z")],
    "<div class=content><table>lost<tr><td class=legal>cell</div>still<td>next</table>end</div>after": [(".content", "lost cell still next end"), (".legal", "cell still")],
    "<table><tr><td class=legal>a<tr><td>b<tbody><td class=policy>c": [(".legal", "a"), (".policy", "c")],
    "<table class=policy><tr><td>cell</td></tr>out<tr><td>two</table>": [(".policy", "cell two")],
    "<table><tr class=legal><td>a<table><tr><td>b</table>c<tr><td>d</table>": [(".legal", "a b c")],
    "<table class=legal><tr><table class=policy><tr><td>x</table>y": [(".legal", ""), (".policy", "x")],
    "<table><div class=legal>x</div><tr><td>y</table>": [(".legal", "x")],
    "<td class=legal>x": [],
    "<p class=legal>1<i class=policy>2<p>3</i>4": [(".legal", "12"), (".policy", "2"), (".policy", "3")],
    "<i class=policy>1<div class=legal>2</i>3</div>4": [(".policy", "1"), (".policy", "2"), (".legal", "23")],
    "<table><tr><td><i class=policy>a<td>b</table>c": [(".policy", "a")],
    "<template><div class=legal>x</div></template>": [],
    "<noscript><div class=legal>x</div></noscript><textarea><i class=legal></textarea>": [],
    "<svg><path class=legal /><g><p class=policy>a": [(".legal", ""), (".policy", "a")],
    "<form><div><form class=legal>x</form>y": [],
    '<div class="legal" class="policy">x': [(".legal", "x")],
}


@pytest.mark.parametrize("html", BLOCKS)
def test_blocks(html):
    # elements that start at one place: the outer one first, parts of a split one as they were made
    assert sorted(read(html)[0]) == sorted(BLOCKS[html])


LINKS = {
    "<a href=x>1<div class=legal>2</a>3</div>": ["1", "2"],
    "<a href=1>x<a href=2>y": ["x", "y"],
    "<a href=1><p>x<a href=2>y</p>": ["", "x", "y"],
    "<p><a href=1>x<p>y</a>z": ["x", "y"],
    "<a href=1><div><section>x</a>y": ["", "", "x"],
    "<a href=1>x</b>y</a>z": ["xy"],
    "<a>x<a href=1>y</a>": ["y"],
    "<table><tr><td><a href=1>a</a></td></tr><a href=2>b</a></table>": ["b", "a"],
    "<a href=1>a<table><tr><td><a href=2>b</table>c": ["abc", "b"],
    "<div><a href=1>a</div>b</a>c": ["a", "b"],
}


@pytest.mark.parametrize("html", LINKS)
def test_links(html):
    assert [x.replace(" ", "") for x in read(html)[1]] == LINKS[html]


def test_text_before_a_table_that_cannot_hold_it():
    assert read("<p>a<table><tr>b<td>c</td>d<td>e</tr></table>f")[2] == "a bd c e f"
    assert read("<table><tr><td><table>x<tr><td>y</table></table>")[2] == "x y"
    assert read("<title>A &amp; <b></title>text")[2] == "text"


@pytest.mark.parametrize(
    "html",
    [
        "<p><button>" + "<div>" * 30_000,
        "<div>" * 30_000 + "<li></li>" * 30_000,
        "<li>" + "<div>" * 30_000 + "</ul>" * 30_000,
        "<a href=x>" + "<div>" * 30_000 + "</a>" * 30_000,
        "<div><a href=x>" * 30_000,
        "<table><tr><td>" * 10_000 + "x",
        "<table><tr>x<i class=legal>" * 10_000,
        "<p><i class=legal>" * 20_000,
        "<p><a href=x>" * 20_000,
        "".join(f"<p><i class='legal x{k}'>" for k in range(10_000)),
        "<svg>" * 20_000 + "<p>" * 20_000,
        "<table>" + "<b>x</b>" * 30_000,
    ],
)
def test_linear_time(html):
    began = time.perf_counter()
    tree = _Tree()
    tree.feed(html)
    tree.done()
    assert time.perf_counter() - began < 8
