"""Main text of web pages by the maximum-scoring run of words and tags.

A page is a sequence of words and tags. Words score above zero and tags below it, by
weights learned from pages that label their own content with an article or main element;
one linear scan finds the contiguous run with the highest sum, whose words are the text.
Elements that are marked as something else (menus, adverts, forms, comments and the
like) score nothing and aren't read, so that they don't tear a run apart either.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment, a declaration or a tag; a tag without an end stops at the next one. No part is read twice.
_MARKUP = re.compile(
    r"<(?:!--|!\[CDATA\[|[!?][^>]*>?|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"'<=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>?)"
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Elements without text to read.
SILENT = frozenset("script style noscript template svg iframe object canvas math title textarea select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that an end tag of an inline element, p or li doesn't close.
WALLS = frozenset("article main nav footer aside td div section".split())
CONTENT = frozenset({"article", "main"})
BOILER = frozenset("nav footer aside form header menu dialog button".split())
#: Words in a class, id or role that mark an element as something else than content ...
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice newsletter subscribe subscription signup popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus respond replies share sharing social related recommended pagination pager toolbar widget widgets complementary contentinfo search dialog alert alertdialog".split()
)
#: Those of them that mark whatever else the name says ...
SURE_WORDS = frozenset("comment comments commentlist disqus related recommended newsletter sidebar breadcrumb breadcrumbs advert adverts advertisement adsense sponsored pagination".split())
#: ... but for names that tell of a layout (has-sidebar, no-comments).
LAYOUT_WORDS = frozenset("no not has have with without is show hide hidden count".split())
#: The others mark if all else in the same name only tells where or what kind of box it is.
BOX_WORDS = frozenset("left right top bottom site page post entry blog area box wrap wrapper container list item items block bar inner outer slot unit links link buttons button section group panel form thread primary secondary global sticky fixed mobile desktop small large the js posts articles reader readers user users body inline more latest popular".split())
#: Used where no page labels its content.
PRIOR_WORD, PRIOR_TAG, PRIOR_TAGS = 1.0, 1.0, {"a": 2.0, "li": 1.0, "article": 40.0, "main": 40.0, "nav": 40.0, "footer": 40.0, "aside": 40.0, "header": 40.0, "form": 40.0, "p": 0.25, "br": 0.25}
#: Most that a tag costs, in words: labelled pages of one shape mustn't forbid what other articles hold.
MOST_COST, COSTS, EDGE_COST = 2.0, {"a": 2.0, "li": 1.0}, 40.0
EDGES = CONTENT | {"nav", "footer", "aside", "header", "form"}
LEAST_COST = 0.25


@dataclass
class Weights:
    """word: score of a word; tags: cost of each tag name; other: of any other tag."""

    word: float = PRIOR_WORD
    tags: dict[str, float] = field(default_factory=lambda: dict(PRIOR_TAGS))
    other: float = PRIOR_TAG


def _names_boiler(value: str) -> bool:
    """If one of the names in a class, id or role is a mark: reader-comments and menu-left are, has-sidebar and share-price aren't."""
    for name in value.split():
        parts = {p.lower() for p in _PART.findall(name) if not p.isdigit()}
        if not SURE_WORDS.isdisjoint(parts) and LAYOUT_WORDS.isdisjoint(parts):
            return True
        if not BOILER_WORDS.isdisjoint(parts) and parts <= BOILER_WORDS | BOX_WORDS:
            return True
    return False


def _marked(name: str, attributes: str) -> bool:
    if name in BOILER:
        return True
    if not attributes or name in ("body", "html", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value.lower()):
            return True
        if key in ("class", "id", "role") and _names_boiler(value):
            return True
    return False


@dataclass
class Page:
    """A page's tokens and elements.

    A token is (is tag, element, text or tag name, number of words). An element has a
    parent (of smaller number), a name, a mark and a range of tokens.
    """

    tokens: list[tuple[bool, int, str, int]] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [-1])
    name: list[str] = field(default_factory=lambda: [""])
    mark: list[bool] = field(default_factory=lambda: [False])
    first: list[int] = field(default_factory=lambda: [0])
    end: list[int] = field(default_factory=lambda: [0])

    def dropped(self) -> list[bool]:
        """If an element isn't read: a marked one and all inside it.

        A mark doesn't count on an element that holds most of the page's words, unless
        the page labels its content and the element doesn't hold the label.
        """
        words, label = [0] * len(self.name), [n in CONTENT for n in self.name]
        for _, e, _, n in self.tokens:
            words[e] += n
        for e in range(len(words) - 1, 0, -1):
            words[self.parent[e]] += words[e]
            label[self.parent[e]] |= label[e]
        out = [False] * len(words)
        for e in range(1, len(out)):
            out[e] = out[self.parent[e]] or self.mark[e] and (2 * words[e] <= words[0] or label[0] and not label[e])
        return out


def parse(page: str) -> Page:
    """One pass over a page; the work on a tag doesn't depend on how deep it stands."""
    out = Page()
    tokens, stack = out.tokens, [0]
    places: dict[str, list[int]] = defaultdict(list)  # depths at which a name is open
    blocks, walls, unclosed = [0], [0], set()  # depths of open elements that aren't inline, and of walls

    def text(chunk: str) -> None:
        if n := len(chunk.split()):
            tokens.append((False, stack[-1], chunk, n))
        elif chunk and tokens and not tokens[-1][0]:
            tokens.append((False, stack[-1], " ", 0))

    def close(depth: int) -> None:
        while len(stack) > depth:
            e = stack.pop()
            out.end[e] = len(tokens)
            places[out.name[e]].pop()
            for open_at in (blocks, walls):
                if open_at[-1] == len(stack):
                    open_at.pop()

    at = 0
    while (m := _MARKUP.search(page, at)) is not None:
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            ends = "-->" if m[0] == "<!--" else "]]>" if m[0] == "<![CDATA[" else ""
            if ends:
                at = page.find(ends, at)
                at = len(page) if at < 0 else at + len(ends)
            continue
        name = m[2].lower()
        if m[1]:
            of = stack[-1]
            if places[name]:
                depth = places[name][-1]
                if not (name in INLINE or name in ("p", "li")) or walls[-1] <= depth:
                    ended = stack[depth]
                    close(depth)
                    of = ended if out.mark[ended] else stack[-1]
            tokens.append((True, of, name, 0))
            continue
        if name in SILENT:
            over = re.compile(rf"</{name}\s*>", re.I).search(page, at) if name not in unclosed else None
            if over:
                at = over.end()
            elif name in ("script", "style"):
                at = len(page)
            unclosed.update([] if over else [name])
            text(" ")
            continue
        if name not in INLINE and name not in VOID:  # a block ends an open paragraph and its inline elements
            above = out.name[stack[blocks[-1]]]
            if above == "p" or above == name == "li":
                close(blocks[-1])
        opens = name not in VOID and not m[3].rstrip().endswith("/")
        marked = opens and _marked(name, m[3])
        # the tags of a marked element are its own, so that one that isn't read doesn't part what stands around it
        tokens.append((True, len(out.name) if marked else stack[-1], name, 0))
        if opens:
            out.parent.append(stack[-1])
            out.name.append(name)
            out.mark.append(marked)
            out.first.append(len(tokens))
            out.end.append(0)
            places[name].append(len(stack))
            if name not in INLINE:
                blocks.append(len(stack))
            if name in WALLS:
                walls.append(len(stack))
            stack.append(len(out.name) - 1)
    text(page[at:])
    close(1)
    out.end[0] = len(tokens)
    return out


def best_run(page: Page, w: Weights, dropped: list[bool]) -> tuple[int, int] | None:
    """First and last token of the run with the highest sum; None if no sum is above zero."""
    best, run, start, found = 0.0, 0.0, 0, None
    for i, (is_tag, e, what, n) in enumerate(page.tokens):
        if not dropped[e]:
            run += -w.tags.get(what, w.other) if is_tag else w.word * n
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, found = run, (start, i)
    return found


def _rounded(page: Page, run: tuple[int, int], dropped: list[bool]) -> tuple[int, int]:
    """The run, to the ends of each article or main element that most of its words, or that has most of its words, in it."""
    upto = [0, *accumulate(0 if dropped[e] else n for _, e, _, n in page.tokens)]
    first, last = run
    inside = upto[last + 1] - upto[first]
    for e, name in enumerate(page.name):
        if name in CONTENT and not dropped[e]:
            own = upto[page.end[e]] - upto[page.first[e]]
            both = upto[max(page.first[e], min(page.end[e], run[1] + 1))] - upto[min(page.end[e], max(page.first[e], run[0]))]
            if both > 0 and (2 * both > inside or 2 * both > own):
                first, last = min(first, page.first[e]), max(last, page.end[e] - 1)
    return first, last


def extract(page: str | None, w: Weights) -> str:
    """Main text of one page; empty for null, empty or wordless pages."""
    if not page:
        return ""
    p = parse(page)
    dropped = p.dropped()
    run = best_run(p, w, dropped)
    if run is None:
        return ""
    first, last = _rounded(p, run, dropped)
    blocks: list[list[str]] = [[]]
    for is_tag, e, what, _ in p.tokens[first : last + 1]:
        if is_tag:
            if what not in INLINE or what == "br":
                blocks.append([])
        elif not dropped[e]:
            blocks[-1].append(what)
    done = (_SPACE.sub(" ", html.unescape("".join(b))).strip() for b in blocks if b)
    return " ".join(b for b in done if b)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token kind, inside the labelled content, count) over pages that label it."""
    counts: Counter = Counter()
    for batch in batches:
        for html_text in batch.column(0).to_pylist():
            page = parse(html_text or "")
            if CONTENT.isdisjoint(page.name):
                continue
            dropped, inside = page.dropped(), [False] * len(page.name)
            for e in range(1, len(inside)):
                inside[e] = inside[page.parent[e]] or page.name[e] in CONTENT
            for is_tag, e, what, n in page.tokens:
                counts[("<" + what if is_tag else "w", inside[e] and not dropped[e])] += 1 if is_tag else n
    rows = list(counts.items())
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for (k, _), _ in rows], pa.string()), pa.array([i for (_, i), _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())],
        ["kind", "inside", "n"],
    )


def fit(pages: DataFrame, sample: int = 2000) -> Weights:
    """Weights from at most `sample` pages that label their content.

    The bound is on labelled pages that are read for fitting, taken by the smallest
    hash of page_id; extraction itself reads every page whole.
    """
    labelled = pages.where(F.col("html").rlike(r"(?i)<(article|main)\b"))
    ids = labelled.select(F.xxhash64("page_id").alias("h")).orderBy("h").limit(sample)
    last = ids.agg(F.max("h")).first()[0]
    if last is None:
        return Weights()
    rows = labelled.where(F.xxhash64("page_id") <= last).select("html").limit(2 * sample).mapInArrow(_counted, "kind string, inside boolean, n long")
    seen: dict[str, list[int]] = {}
    for kind, inside, n in rows.groupBy("kind", "inside").agg(F.sum("n")).collect():
        seen.setdefault(kind, [0, 0])[inside] += n
    total = [sum(v[i] for v in seen.values()) + 1 for i in (0, 1)]
    odds = {k: math.log((v[1] + 0.5) / total[1]) - math.log((v[0] + 0.5) / total[0]) for k, v in seen.items()}
    word = max(0.1, odds.get("w", 0.1))
    # a tag's cost in words: how much rarer it is inside content, within bounds; no tag adds to the score
    most = lambda tag: EDGE_COST if tag in EDGES else COSTS.get(tag, MOST_COST)
    tags = {k[1:]: min(most(k[1:]), max(LEAST_COST, 0.5 - 4 * v)) * word for k, v in odds.items() if k != "w"}
    return Weights(word, {k: v * word for k, v in PRIOR_TAGS.items()} | tags, PRIOR_TAG * word)


def _extracting(w: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(p, w) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    Null or empty html gives empty text; rows with null page_id or url and repeated
    rows each give a row; other columns aren't read.
    """
    w = weights or fit(pages)
    return pages.select("page_id", "url", "html").mapInArrow(_extracting(w), "page_id long, url string, text string, n_chars long")
