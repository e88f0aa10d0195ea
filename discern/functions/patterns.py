"""Compiles the rule pack's patterns into Spark columns, and into SQL for another engine."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, in the wide sense in which texts are normalised. Of its rare members the JVM tests the range first, so that a letter costs two tests.
BLANK = r"[ \t-\r\xA0[ -﻿&&[  -     　﻿]]]"
#: Blanks that aren't one blank by itself. Between most words nothing is to be replaced then; the JVM takes long over each match.
UNEVEN_BLANKS = rf"[\t-\r\xA0[ -﻿&&[  -     　﻿]]]{BLANK}*+| {BLANK}++"


def java(pattern: str) -> str:
    """For the JVM, whose \\b knows all letters: word boundaries on ASCII words only.

    A boundary in front of a word becomes a look-behind, one after it a look-ahead.
    """
    out, at = [], 0
    for m in re.finditer(r"\\b", pattern):
        out.append(pattern[at : m.start()])
        follows = pattern[m.end() : m.end() + 1]
        opens = follows != "" and (follows.isalnum() or follows == "(") and (m.start() == 0 or not (pattern[m.start() - 1].isalnum() or pattern[m.start() - 1] in "?)"))
        out.append(r"(?<!\w)" if opens else r"(?!\w)")
        at = m.end()
    return "(?i)" + "".join(out) + pattern[at:]


def needed(pattern: str) -> str:
    """The longest text that every match holds, in lower case; empty if there is none for sure.

    A substring search for it is far cheaper than the pattern, and nearly always decides.
    """
    if "|" in re.sub(r"\([^)]*\)", "", pattern):
        return ""
    plain = re.sub(r"\\b", "", pattern)
    plain = re.sub(r"\([^)]*\)[?*]?|\[[^\]]*\][?*+]?|\.[*+?]?", "\n", plain)
    plain = re.sub(r".\?", "\n", plain)
    return max(plain.split("\n"), key=len).lower()


def text_sql(text: str) -> str:
    """A text as a literal; it holds no double quote."""
    assert '"' not in text
    return f'r"{text}"'


def pattern_sql(text: str, pattern: str) -> str:
    return f"{text} rlike {text_sql(java(pattern))}"


def let_sql(value: str, name: str, body: str) -> str:
    """body, with value worked out once under a name however often the body uses it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


class Text:
    """A text and its lower-cased form, both as SQL, against which patterns are tested."""

    def __init__(self, text: str, low: str | None = None):
        self.text = text
        self.low = low or f"lower({text})"

    def has(self, pattern: str) -> str:
        word = needed(pattern)
        match = pattern_sql(self.text, pattern)
        return f"(contains({self.low}, {text_sql(word)}) and {match})" if len(word) >= 3 else f"({match})"

    def any(self, patterns: Iterable[str]) -> str:
        return "(" + (" or ".join(map(self.has, patterns)) or "false") + ")"

    def count(self, patterns: Iterable[str]) -> str:
        """How many of the patterns match (each counts once)."""
        return "(" + (" + ".join(f"if({self.has(p)}, 1, 0)" for p in patterns) or "0") + ")"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def evaluated(text: str, make: Callable[[Text], str]) -> str:
    """make(Text(text)), kept out of generated code.

    Dozens of patterns in one generated method pass the limits up to which the JVM
    compiles it; as the body of a higher-order function they are evaluated one by one.
    """
    return let_sql(f"named_struct('text', {text}, 'low', lower({text}))", "t", make(Text("t.text", "t.low")))


def computed_sql(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """with_computed() for expressions in SQL."""
    return with_computed(df, {k: F.expr(v) for k, v in columns.items()})


def with_computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with more columns, as withColumns(), but never worked out more than once a row.

    They come from a generator of one row: a filter on them isn't pushed below it,
    where it would repeat a costly expression for each use.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def first_points(text: str, points: Iterable[tuple[str, int]]) -> str:
    """The points of the first pattern that matches, else 0."""
    return "(case " + " ".join(f"when {pattern_sql(text, p)} then {n}" for p, n in points) + " else 0 end)"
