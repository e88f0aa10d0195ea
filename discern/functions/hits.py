"""Which patterns of the rule pack a text matches, as bits, found in one pass over its sentences.

Every pattern needs a word, at a word's start. One expression with all these words, as a
prefix tree, is run over a sentence; only the patterns whose words it finds are tested.
A sentence is tested once, although it stands in up to six units of one to three
sentences: a unit matches what its sentences match, and what matches across a join. Only
patterns that hold a blank can do that. Those of fixed words can't where the sentence in front of
the join ends with a mark; and across two joins only those long or open enough to hold a sentence.

Expressions of hundreds of parts are written as SQL text, one call each: built as columns,
every part is a call to the JVM, and a plan took longer to build than to run.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules
from .patterns import computed_sql, let_sql, pattern_sql, text_sql

#: Bits of a long that are used.
WIDTH = 60
PATTERNS = sorted(
    {
        *(p for r in rules.FINDINGS for p in (*r.strong, *r.medium, *r.negations)),
        *(p for ps in (rules.NEGATION, rules.PERMISSION, rules.SAFE_FUNCTION, rules.AD_TECH, *rules.CATEGORIES.values()) for p in ps),
    }
)


def starts(pattern: str) -> list[str]:
    """Words, in lower case, whose letters every match of a pattern holds from a word's start on; the last ones may go on in the text."""
    plain = pattern.replace(r"\b", "\x01")
    if "|" in re.sub(r"\([^)]*\)", "", plain):
        return []
    plain = re.sub(r"\([^)]*\)[?*]?|\[[^\]]*\][?*+]?|\.[*+?]?|.\?", "\n", plain)
    return [w.lower() for w in re.findall(r"(?<=[^\w\n])\w+", plain, re.A)]


def _key(pattern: str) -> str:
    return max(starts(pattern), key=len)


LITERALS = sorted({_key(p) for p in PATTERNS})
_ORDER = sorted(PATTERNS, key=_key)  # patterns of a word stand together
_PLACE = {p: divmod(k, WIDTH) for k, p in enumerate(_ORDER)}
_WORD_PLACE = {w: divmod(k, WIDTH) for k, w in enumerate(LITERALS)}
MASKS, WORD_MASKS = (f"m{k}" for k in range(-(-len(PATTERNS) // WIDTH))), (f"w{k}" for k in range(-(-len(LITERALS) // WIDTH)))
MASKS, WORD_MASKS = tuple(MASKS), tuple(WORD_MASKS)

#: A match of these can hold text of any length.
OPEN = [p for p in PATTERNS if "." in p]
#: Fixed words with a blank between; no mark that ends a sentence stands among them.
PHRASES = [p for p in PATTERNS if " " in p and p not in OPEN]
#: The longest phrases can hold a whole sentence between two joins.
LONG = [p for p in PHRASES if len(re.sub(r"\\b|[()?]", "", p)) >= rules.LEAST_SENTENCE + 4]


def _bits(patterns: Iterable[str]) -> list[int]:
    out = [0] * len(MASKS)
    for p in patterns:
        k, at = _PLACE[p]
        out[k] |= 1 << at
    return out


def _word_bits(words: Iterable[str]) -> list[int]:
    out = [0] * len(WORD_MASKS)
    for w in words:
        k, at = _WORD_PLACE[w]
        out[k] |= 1 << at
    return out


def has_any(hits: str, patterns: Iterable[str]) -> str:
    """Does a text with these bits match one of the patterns? hits: "" for columns m0, ..., or a struct's name and a dot."""
    return "(" + (" or ".join(f"({hits}{m} & {b}L) != 0" for m, b in zip(MASKS, _bits(patterns)) if b) or "false") + ")"


def count_of(hits: str, patterns: Iterable[str]) -> str:
    """How many of the patterns it matches (each counts once)."""
    return "(" + (" + ".join(f"bit_count({hits}{m} & {b}L)" for m, b in zip(MASKS, _bits(patterns)) if b) or "0") + ")"


def _tree(words: Iterable[str]) -> str:
    """An expression for the longest of some words at a place, with common beginnings once."""
    by: dict[str, list[str]] = {}
    for w in words:
        if w:
            by.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(c) + _tree(rest) for c, rest in sorted(by.items())]
    body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    return "" if not parts else f"(?:{body})?" if "" in words else body


WORDS = rf"(?i)(?<!\w){_tree(LITERALS)}"


def struct_sql(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _found(text: str) -> str:
    """The bits of the words that a text holds: of each word found, and of those that begin it."""
    also = {w: _word_bits(v for v in LITERALS if w.startswith(v)) for w in LITERALS}
    known = "map(" + ", ".join(f"'{w}', {struct_sql(dict(zip(WORD_MASKS, (f'{b}L' for b in bits))))}" for w, bits in also.items()) + ")"
    join = let_sql(f"element_at({known}, lower(word))", "b", struct_sql({n: f"bits.{n} | b.{n}" for n in WORD_MASKS}))
    return f"aggregate(regexp_extract_all({text}, {text_sql(WORDS)}, 0), {struct_sql(dict.fromkeys(WORD_MASKS, '0L'))}, (bits, word) -> {join})"


def _tested(text: str, words: str, patterns: Iterable[str], known: str = "") -> str:
    """The bits of those patterns that a text matches, by the words that it holds; of those it is known to match nothing is tested."""
    by: dict[tuple, list[str]] = {}
    for p in patterns:
        need = _word_bits(v for v in LITERALS if any(w.startswith(v) for w in starts(p)))
        by.setdefault((_PLACE[p][0], tuple(need)), []).append(p)
    out: list[list[str]] = [[] for _ in MASKS]
    for (k, need), same in by.items():
        bits = []
        for p in same:
            b = f"{1 << _PLACE[p][1]}L"
            new = f"({known}.{MASKS[k]} & {b}) = 0 and " if known else ""
            bits.append(f"if({new}{pattern_sql(text, p)}, {b}, 0L)")
        there = " and ".join(f"({words}.{n} & {b}L) = {b}L" for n, b in zip(WORD_MASKS, need) if b)
        out[k].append(f"if({there}, {' + '.join(bits)}, 0L)")
    return struct_sql({m: " + ".join(x) or "0L" for m, x in zip(MASKS, out)})


NO_BITS = struct_sql(dict.fromkeys(MASKS, "0L"))
_BITS_TYPE = ", ".join(f"{m}: bigint" for m in MASKS)
PARTS_TYPE = f"array<struct<text: string, {_BITS_TYPE}>>"


def hits_of(text: str) -> str:
    """(text, closed, some, w0, ..., m0, ...): does it end with a mark, does it hold a needed word, bits of these and of the patterns that it matches."""
    some = " or ".join(f"words.{n} != 0" for n in WORD_MASKS)
    ends = " or ".join(f"endswith({text}, '{c}')" for c in ".!?")
    fields = {"text": text, "closed": f"({ends})", "some": f"({some})"} | {n: f"words.{n}" for n in WORD_MASKS} | {m: f"bits.{m}" for m in MASKS}
    return let_sql(_found(text), "words", let_sql(f"if({some}, {_tested(text, 'words', PATTERNS)}, {NO_BITS})", "bits", struct_sql(fields)))


def _united(parts: Iterable[str], names: Iterable[str]) -> dict[str, str]:
    return {n: "(" + " | ".join(f"{p}.{n}" for p in parts) + ")" for n in names}


def _across(hits: str, n: int, known: list[str]) -> str:
    """The bits of what the n sentences from the i-th on match only together; known: bits of what parts of them match."""
    own = [f"get({hits}, i + {k})" for k in range(n)]
    text = "concat_ws(' ', " + ", ".join(f"{s}.text" for s in own) + ")"
    phrases = LONG if n > 2 else PHRASES
    open_joins = " and ".join(f"not {s}.closed" for s in own[:-1])
    # the text is put together only where a pattern's words are all there
    tests = f"if({open_joins}, {_tested(text, 'x', [*OPEN, *phrases], 'x')}, {_tested(text, 'x', OPEN, 'x')})"
    there = " or ".join(f"{s}.some" for s in own)
    return f"if({there}, {let_sql(struct_sql(_united(own, WORD_MASKS) | _united([*own, *known], MASKS)), 'x', tests)}, {NO_BITS})"


def _with_joins(docs: DataFrame, hits: str) -> DataFrame:
    """docs with __two and __three, the bits that only the two or three sentences from each place on match together.

    Where none of them holds a needed word there is nothing to look for; without any in the document they are empty.
    """
    rows = docs
    for n, name, known in ((2, "__two", []), (3, "__three", ["get(__two, i)", "get(__two, i + 1)"])):
        joins = f"transform(sequence(0, size({hits}) - {n}), i -> {_across(hits, n, known)})"
        rows = computed_sql(rows, {name: f"if(exists({hits}, h -> h.some) and size({hits}) >= {n}, {joins}, cast(array() as array<struct<{_BITS_TYPE}>>))"})
    return rows


def with_hits(docs: DataFrame, sentences: str, name: str = "hits") -> DataFrame:
    """docs with hits_of() each sentence of an array column."""
    return computed_sql(docs, {name: f"transform({sentences}, s -> {hits_of('s')})"})


def with_units(docs: DataFrame, hits: str, wanted: Callable[[str], str]) -> DataFrame:
    """docs with units (ord, unit, parts, m0, ...): the distinct chunks whose bits are wanted, in order of chunks().

    parts (text, m0, ...) are what a unit's text falls into again: runs of its sentences, parted
    behind those that end with a mark. Of a unit of one sentence there are none.
    """
    last = f"(size({hits}) - 1)"

    def text(i: str, n: str | int) -> str:
        return f"array_join(transform(slice({hits}, {i} + 1, {n}), h -> h.text), ' ')"

    def bits(i: str, n: int) -> dict[str, str]:
        return _united([f"get({hits}, {i} + {k})" for k in range(n)] + [f"get(__two, {i} + {k})" for k in range(n - 1)] + ([f"get(__three, {i})"] if n == 3 else []), MASKS)

    own = ", ".join(f"if(i + {n} - 1 <= {last}, {struct_sql({'i': 'i', 'n': str(n)} | bits('i', n))}, null)" for n in (1, 2, 3))
    near = " or ".join(f"coalesce(get({hits}, i + {k}).some, false)" for k in range(3))
    runs = f"flatten(transform(filter(sequence(0, {last}), i -> {near}), i -> filter(array({own}), r -> r is not null and {wanted('r.')})))"
    rows = computed_sql(_with_joins(docs, hits), {"__some": f"if(exists({hits}, h -> h.some), {runs}, null)"})
    # chunks can only be equal where sentences are, or where one without a mark at its end runs into the next
    plain = f"size(array_distinct(transform({hits}, h -> h.text))) = size({hits}) and forall(slice({hits}, 1, greatest({last}, 0)), h -> h.closed)"
    rows = computed_sql(rows, {"__plain": f"size(__some) > 0 and {plain}"})
    every = f"flatten(transform({hits}, (h, i) -> transform(sequence(1, least(3, {last} + 1 - i)), n -> {text('i', 'n')})))"
    rows = computed_sql(rows, {"__texts": f"if(size(__some) > 0 and not __plain, {every}, null)"})
    rows = computed_sql(rows, {"__distinct": "array_distinct(__texts)"})

    def part(i: str, n: int) -> str:
        return struct_sql({"text": text(i, n)} | bits(i, n))

    first, second = f"get({hits}, r.i).closed", f"get({hits}, r.i + 1).closed"
    one, two, three = "r.i", "r.i + 1", "r.i + 2"
    parts = f"""case when r.n = 1 then cast(array() as {PARTS_TYPE})
      when r.n = 2 then if({first}, array({part(one, 1)}, {part(two, 1)}), array({part(one, 2)}))
      when {first} and {second} then array({part(one, 1)}, {part(two, 1)}, {part(three, 1)})
      when {first} then array({part(one, 1)}, {part(two, 2)})
      when {second} then array({part(one, 2)}, {part(three, 1)})
      else array({part(one, 3)}) end"""
    place = f"3 * r.i + r.n - 1 - if(r.i = {last} and {last} > 0, 1, 0)"  # among all runs
    unit = struct_sql({"ord": "if(__plain, x.place, cast(array_position(__distinct, x.own) - 1 as int))", "unit": "x.own", "parts": parts} | {m: f"r.{m}" for m in MASKS})
    # of equal chunks the first counts
    made = let_sql(struct_sql({"place": place, "own": text("r.i", "r.n")}), "x", f"if(__plain or array_position(__texts, x.own) = x.place + 1, {unit}, null)")
    none = f"cast(array() as array<struct<ord: int, unit: string, parts: {PARTS_TYPE}, {_BITS_TYPE}>>)"
    rows = computed_sql(rows, {"units": f"coalesce(if(size(__some) > 0, array_compact(transform(__some, r -> {made})), null), {none})"})
    return rows.drop("__two", "__three", "__some", "__plain", "__texts", "__distinct")
