"""Web pages: title, text blocks, visible text and links.

One pass over a page's tags, in an Arrow task, gives all of them: text blocks of all
selectors with nesting, aria-label, and the elements around a link. There is no CSS:
text of block elements is parted by blanks, and text of inline elements isn't.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .addresses import resolve

#: Elements without text of their own.
SILENT = ("script", "style", "noscript", "svg", "video", "audio")
#: Selectors of text blocks, in the order in which blocks are joined.
SELECTORS = ("main", "article", "[role=main]", ".privacy", ".policy", ".legal", ".content", ".main-content", ".entry-content", ".page-content")
#: Elements around a link that count (tags, and a class).
FRAMES, FRAME_CLASS = ("footer", "nav"), "footer"

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FLOW = frozenset("a abbr b bdi bdo cite code data em font i kbd label mark q s samp small span strong sub sup time u var".split())
#: Fixed values of the HTML Standard: groups of elements that its tree construction treats alike.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = _HEADINGS | frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_ROWS = frozenset("table tbody tfoot thead tr".split())
_CELLS = frozenset("caption td th".split())
_TABLE_PARTS = _ROWS | _CELLS | {"col", "colgroup"}
_SPECIAL = _CLOSES_P | _HEAD | _TABLE_PARTS | frozenset(
    "applet area body br button embed frame frameset head html iframe img input keygen marquee noembed object param select source textarea track wbr".split()
)
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_SCOPES = _CELLS | frozenset("applet html marquee object table template".split())
_MARKERS = _CELLS | frozenset("applet marquee object template".split())
_LEAVES_FOREIGN = _HEADINGS | frozenset(
    "b big blockquote body br center code dd div dl dt em embed head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
#: What may be a character reference after its ampersand, and one that ends with its semicolon.
_REFERENCE = re.compile(r"&(?=#?[0-9A-Za-z])(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[0-9A-Za-z]{1,32};)?")
#: Where a part of a table stands: what is open further inside is closed before it.
_HOLDERS = {"td": _ROWS, "th": _ROWS, "tr": _ROWS - {"tr"}}


def _selectors(name: str, attrs: dict[str, str]) -> list[int]:
    """Which of SELECTORS an element matches."""
    classes = attrs.get("class", "").split()
    own = {name, *("." + c for c in classes), "[role=main]" if attrs.get("role") == "main" else ""}
    return [k for k, s in enumerate(SELECTORS) if s in own]


class _Mark:
    """A place between pieces of text; `at` is known once the page is read."""

    __slots__ = ("at",)


class _Open:
    """An open element, with what follows for those inside it. Depths are of the nearest element of a kind, itself included."""

    __slots__ = ("name", "depth", "into", "done", "start", "end", "record", "slot", "silent", "framed", "hidden", "scope", "button", "list", "special", "stop", "table", "foreign")

    def __init__(self, name: str, depth: int, around: _Open | None) -> None:
        near = lambda k, here: depth if here or around is None else getattr(around, k)
        plain = around is None or not around.foreign
        self.name, self.depth, self.done = name, depth, False
        self.start = self.end = self.record = self.slot = None
        self.scope = near("scope", plain and name in _SCOPES)
        self.button = near("button", plain and (name in _SCOPES or name == "button"))
        self.list = near("list", plain and (name in _SCOPES or name in ("ol", "ul")))
        self.special = near("special", plain and name in _SPECIAL)
        self.stop = near("stop", plain and name in _SPECIAL and name not in ("address", "div", "p"))
        self.table = near("table", name in ("table", "template"))
        self.foreign = depth if name in ("math", "svg") else 0 if plain or name in ("desc", "foreignobject") else around.foreign
        self.silent = around is not None and around.silent or name in SILENT or name in ("template", "title")
        self.hidden = around is not None and around.hidden or name == "template"
        self.framed = around is not None and around.framed or name in FRAMES


class _Tree(HTMLParser):
    """Text pieces in order, and the ranges of them that elements span, by the tree that a browser builds.

    Ends are implied, an end tag reaches no further than its scope, what a table can't hold
    stands before it, and formatting elements go on where a block ended them, and end inside
    blocks that go on. Elements that would be split are ranges of their own for each part.
    Each tag costs a bounded number of steps: open elements know their nearest limits.
    Departures: of formatting elements, those that neither link nor match a selector aren't
    carried on, and at most three that match the same selectors are.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list = []  # texts, marks, and lists of what stands before a table
        self.open = [_Open("", 0, None)]
        self.open[0].into = self.pieces
        self.where: dict[str, list[int]] = defaultdict(list)  # depths of open elements by name
        self.active: list = []  # formatting elements to carry on (name, attributes, element), None where a cell or the like begins
        self.records: list[list] = []  # start, end, selectors, attributes of a link, framed
        self.heading: list[str] = []  # text of the first title
        self.titled = self.in_body = False

    def _top(self) -> _Open:
        while self.open[-1].done:
            self.open.pop()
        return self.open[-1]

    def _end(self, e: _Open) -> None:
        e.done = True
        self.where[e.name].pop()
        if e.record:
            e.into.append(e.end)
        if e.name in _MARKERS and None in self.active:
            while self.active.pop() is not None:
                pass

    def _close(self, depth: int) -> None:
        """Closes the open elements from a depth on."""
        for e in reversed(self.open[depth:]):
            if not e.done:
                self._end(e)
        del self.open[depth:]

    def _last(self, name: str) -> int:
        depths = self.where[name]
        return depths[-1] if depths else 0

    def _close_in(self, name: str, limit: int) -> None:
        """Closes the last open element of a name and all inside it, if it isn't beyond the limit."""
        if (depth := self._last(name)) and depth >= limit:
            self._close(depth)

    def _place(self, name: str) -> list:
        """Where an element or text goes: in the last open element, or before a table that can't hold it."""
        top = self._top()
        misplaced = top.name in _ROWS and name not in _TABLE_PARTS - {"table"} and name not in ("script", "style", "template")
        return self.open[top.table].slot if misplaced and self.open[top.table].slot is not None else top.into

    def _enter(self, name: str, own: dict[str, str], held: bool = True) -> _Open:
        into, around = self._place(name), self._top()
        if name not in FLOW:
            into.append("\n")
        e = _Open(name, len(self.open), around)
        e.into = into
        e.framed = e.framed or FRAME_CLASS in own.get("class", "").split()
        if name == "table":
            e.slot = []
            into.append(e.slot)
        selectors, link = _selectors(name, own), own if name == "a" and "href" in own else None
        if not e.hidden and (selectors or link):
            e.end = _Mark()
            e.record = [None, e.end, selectors, link, e.framed]
            self.records.append(e.record)
        if e.record or name in _SPECIAL and self.where["a"]:
            e.start = _Mark()
            into.append(e.start)
        if e.record:
            e.record[0] = e.start
        if not held:
            e.done = True
            if e.record:
                into.append(e.end)
            return e
        self.open.append(e)
        self.where[name].append(e.depth)
        if name in _MARKERS:
            self.active.append(None)
        return e

    def _carry(self, name: str, own: dict[str, str], e: _Open) -> None:
        """Notes a formatting element that goes on after a block ends it."""
        alike = []
        for k in range(len(self.active) - 1, -1, -1):
            if self.active[k] is None:
                break
            if self.active[k][0] == name and self.active[k][2].record[2] == e.record[2]:
                alike.append(k)
        if len(alike) == 3:
            del self.active[alike[-1]]
        self.active.append([name, own, e])

    def _reopen(self) -> None:
        """Opens the formatting elements again that a block has ended."""
        first = len(self.active)
        while first and self.active[first - 1] is not None and self.active[first - 1][2].done:
            first -= 1
        for f in self.active[first:]:
            f[2] = self._enter(f[0], f[1])

    def _end_formatting(self, name: str) -> bool:
        """Ends the last formatting element of a name that is carried on; False if there is none.

        Blocks inside it stay open, and the part of it inside each of them (the first eight)
        counts as an element.
        """
        k = len(self.active) - 1
        while k >= 0 and self.active[k] is not None and self.active[k][0] != name:
            k -= 1
        if k < 0 or self.active[k] is None:
            return False
        e, top = self.active[k][2], self._top()
        if not e.done and e.depth >= top.scope:
            if top.special < e.depth:
                self._close(e.depth)
            else:
                inside = [x for x in self.open[e.depth + 1 :] if not x.done and x.start and x.name in _SPECIAL and x.into is e.into][:8]
                last, (_, _, selectors, link, _) = e.end, e.record
                bounds = [x.start for x in inside] + [last]
                e.record[1] = bounds[0]
                self.records += [[a, b, selectors, link, x.framed] for x, a, b in zip(inside, bounds, bounds[1:])]
                self._end(e)
        if k < len(self.active) and self.active[k] is not None and self.active[k][2] is e:
            del self.active[k]
        return True

    def _into_body(self) -> None:
        if not self.in_body:
            self.in_body = True
            if head := self._last("head"):
                self._close(head)

    def handle_starttag(self, name: str, attrs: list, closed: bool = False) -> None:
        own = {k: v or "" for k, v in reversed(attrs)}  # the first of two attributes of a name counts
        top = self._top()
        if top.foreign and name in _LEAVES_FOREIGN:
            self._close(top.foreign)
            top = self._top()
        if top.foreign:
            self._enter(name, own, not closed)
            return
        if name in ("html", "head", "frameset", "frame"):
            if name != "html" and self.in_body or self.where[name] or name[0] == "f" or name == "html" and len(self.open) > 1:
                return
        elif name == "body":
            if self.in_body:
                return
            self._into_body()
        elif name not in _HEAD:
            self._into_body()
        if name in _TABLE_PARTS and name != "table":
            if self.open[top.table].name != "table":
                return
            holders = _HOLDERS.get(name, ("table",))
            self._close(max(self._last(h) for h in holders) + 1)
        elif name == "table" and top.name in _ROWS:
            self._close(top.table)
        elif name == "form" and self.where["form"]:
            return
        elif name == "button":
            self._close_in("button", top.scope)
        elif name == "a" and not self._end_formatting("a"):
            self._close_in("a", top.special)
        elif name in ("li", "dd", "dt") and self.open[top.stop].name in (("li",) if name == "li" else ("dd", "dt")):
            self._close(top.stop)
        if name in _CLOSES_P:
            self._close_in("p", self._top().button)
            if name in _HEADINGS and self._top().name in _HEADINGS:
                self._close(self._top().depth)
        elif name not in _HEAD and name not in _TABLE_PARTS and name not in ("html", "head", "body"):
            self._reopen()
        e = self._enter(name, own, name not in VOID)
        if name in _FORMATTING and e.record:
            self._carry(name, own, e)
        if name in _RAW:
            self.set_cdata_mode(name)

    def handle_startendtag(self, name: str, attrs: list) -> None:
        self.handle_starttag(name, attrs, True)

    def handle_endtag(self, name: str) -> None:
        top = self._top()
        if name in ("script", "style") or name not in ("html", "body") and not (name in _FORMATTING and self._end_formatting(name)):
            if name in _HEADINGS:
                depth = max(self._last(h) for h in _HEADINGS)
                if depth and depth >= top.scope:
                    self._close(depth)
            elif name == "p":
                self._close_in(name, top.button)
            elif name == "li":
                self._close_in(name, top.list)
            elif name in _TABLE_PARTS:
                self._close_in(name, top.table)
            else:
                self._close_in(name, top.scope if name in _SPECIAL else top.special)
        if name not in FLOW:
            self._top().into.append("\n")
        self.titled = self.titled or name == "title" and not top.foreign

    def handle_data(self, data: str) -> None:
        top = self._top()
        if top.name in ("title", "textarea") and not top.foreign:
            data = unescape(data)  # raw to the tokenizer
        if top.silent:
            if top.name == "title" and not self.titled and not top.foreign:
                self.heading.append(data)
        elif data.isspace():
            top.into.append(data)
        else:
            self._into_body()
            self._reopen()
            self._place("").append(data)

    def done(self) -> list[str]:
        """All pieces of text in order, once everything is read; marks get their places."""
        self.close()
        self._close(1)
        flat: list[str] = []
        stack = [iter(self.pieces)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, str):
                    flat.append(x)
                elif isinstance(x, list):
                    stack.append(iter(x))
                    break
                else:
                    x.at = len(flat)
            else:
                stack.pop()
        return flat


def _bare_kept(html: str) -> str:
    """html whose references without a semicolon, such as &amp or &copy, are text."""
    whole = lambda name: name and (name[0] == "#" or name in html5)
    return _REFERENCE.sub(lambda m: m[0] if whole(m[1]) else "&amp;" + m[0][1:], html)


def parse_page(html: str | None, url: str | None, bare: bool = True) -> dict:
    """title, main_text, full_text, page_text and links (href, text, in_nav, absolute) of one page (null: empty).

    absolute is the link's address on the page, normalised; null if it has none, as where
    the page's own address is null. bare: whether a reference without its semicolon counts,
    if it is one of those that browsers take so; else it stays as it stands.
    """
    tree = _Tree()
    tree.feed((html or "") if bare else _bare_kept(html or ""))
    pieces = tree.done()
    text_of = lambda first, end: " ".join("".join(pieces[first:end]).split())
    found = sorted((k, start.at, n, end.at) for n, (start, end, selectors, _, _) in enumerate(tree.records) for k in selectors)
    blocks = [text for _, start, _, end in found if len(text := text_of(start, end)) >= rules.LEAST_BLOCK]
    full = text_of(0, len(pieces))[: rules.MAX_TEXT]
    links = []
    for start, end, _, attrs, framed in sorted((r for r in tree.records if r[3] is not None), key=lambda r: r[0].at):
        text = text_of(start.at, end.at) or " ".join(attrs.get("aria-label", "").split())
        links.append({"href": attrs["href"], "text": text, "in_nav": framed, "absolute": resolve(attrs["href"], url)})
    main = ("\n\n".join(blocks) or full)[: rules.MAX_TEXT]
    return {"title": " ".join("".join(tree.heading).split()), "main_text": main, "full_text": full, "page_text": main or full, "links": links}


LINKS = "array<struct<href:string,text:string,in_nav:boolean,absolute:string>>"
_ARROW_LINKS = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string()), ("in_nav", pa.bool_()), ("absolute", pa.string())]))
_TEXTS = ("title", "main_text", "full_text", "page_text")


def _parse_batches(texts: tuple[str, ...], with_links: bool, bare: bool):
    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parse_page(h, u, bare) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            columns = [pa.array([r[k] for r in rows], pa.string()) for k in texts]
            columns += [pa.array([r["links"] for r in rows], _ARROW_LINKS)] if with_links else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["page_id", "url", *texts, *(["links"] if with_links else [])])

    return parsed


def parsed_pages(pages: DataFrame, *columns: str, bare: bool = True) -> DataFrame:
    """(page_id, url) and those of title, main_text, full_text, page_text and links that are asked for (default: all); bare as in parse_page()."""
    wanted = columns or (*_TEXTS, "links")
    texts = tuple(c for c in _TEXTS if c in wanted)
    schema = "page_id long, url string" + "".join(f", {c} string" for c in texts) + (f", links {LINKS}" if "links" in wanted else "")
    return pages.select("page_id", "url", "html").mapInArrow(_parse_batches(texts, "links" in wanted, bare), schema)


def anchors(pages: DataFrame, bare: bool = True) -> DataFrame:
    """(page_id, url, pos, href, text, in_nav, absolute) of each link in page order; bare as in parse_page()."""
    return parsed_pages(pages, "links", bare=bare).select("page_id", "url", F.posexplode("links").alias("pos", "a")).select("page_id", "url", "pos", "a.*")
