"""Text scalars: normalisation, sentences, chunks, snippets and evidence, as columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .patterns import BLANK, UNEVEN_BLANKS, let

#: What parts sentences: blanks behind a full stop or the like, else line ends. Its first step is one test of a character.
PARTING = rf"{BLANK}(?:(?<=[.!?]{BLANK}){BLANK}*+|(?<=\n)\n*+)"
#: The same for texts without other blanks than single ones and line ends.
PLAIN_PARTING = r"[ \n](?:(?<=[.!?][ \n])[ \n]*+|(?<=\n)\n*+)"
#: A text is plain if it holds none of these; searches for bytes cost less than a pattern. Of rare blanks first bytes are enough.
UNEVEN = ("  ", "\t", "\x0B", "\f", "\r")
UNEVEN_BYTES = (b"\xC2\xA0", b"\xE1\x9A\x80", b"\xE2\x80", b"\xE2\x81\x9F", b"\xE3\x80\x80", b"\xEF\xBB\xBF")
QUOTES = "“”\"'`"


def norm(text: Column) -> Column:
    """White space collapsed to one blank and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN_BLANKS, " "))


def is_plain(text: Column) -> Column:
    """Whether no blanks but single ones and line ends are in a text, so that trimming normalises its lines; false also for some that have none."""
    rare = [F.contains(text.cast("binary"), F.lit(x)) for x in UNEVEN_BYTES]
    some = reduce(or_, [*(F.contains(text, F.lit(x)) for x in UNEVEN), (F.octet_length(text) != F.length(text)) & reduce(or_, rare)])
    return ~some


def _sentences(text: Column, parting: str, clean: Callable[[Column], Column]) -> Column:
    most = rules.MAX_SENTENCES
    of = lambda parts: F.filter(F.transform(parts, clean), lambda s: F.length(s) >= rules.LEAST_SENTENCE)
    every = F.slice(of(F.split(text, parting, -1)), 1, most)
    # the last of most + 1 parts is the rest of the text, which is only looked at if some before it were too short
    return let(F.split(text, parting, most + 1), lambda parts: let(of(F.slice(parts, 1, most)), lambda first: F.when((F.size(parts) <= most) | (F.size(first) == most), first).otherwise(every)))


def sentences(text: Column) -> Column:
    """The first MAX_SENTENCES normalised sentences of LEAST_SENTENCE characters or more."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(is_plain(t), _sentences(t, PLAIN_PARTING, lambda s: F.trim(s))).otherwise(_sentences(t, PARTING, norm)))


def chunks(sentences: str) -> Column:
    """Runs of one, two and three sentences in order of their first, each text once."""
    run = lambda i, n: F.array_join(F.slice(sentences, i + 1, n), " ")
    runs = F.transform(sentences, lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size(sentences) - i)), lambda n: run(i, n)))
    return F.array_distinct(F.flatten(runs))


def compare_key(text: Column, clean: bool = False) -> Column:
    """The form in which evidence is compared: lower case, one blank, no quotes. clean: the text is normalised."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    plain = plain if clean else F.regexp_replace(plain, UNEVEN_BLANKS, " ")
    for quote in QUOTES:  # each is a search for bytes
        plain = F.replace(plain, F.lit(quote), F.lit(""))
    return F.trim(plain)


def last_index(text: Column, part: str) -> Column:
    """Place of the last occurrence, from 0; -1 without one."""
    return F.greatest(F.lit(-1), F.length(text) - F.length(F.substring_index(text, part, -1)) - len(part))


def shorten(text: Column, most: int = 220, least: int = 80, clean: bool = False) -> Column:
    """Text of at most `most` characters, cut behind its last clause, else at a word. clean: the text is normalised."""

    def at_word(head: Column) -> Column:
        return let(last_index(head, " "), lambda blank: F.concat(F.trim(F.when(blank > least, F.left(head, blank)).otherwise(head)), F.lit("…")))

    def cut(head: Column) -> Column:
        clause = F.greatest(*(last_index(head, p) for p in (". ", "; ", ", ")))
        return let(clause, lambda at: F.when(at > least, F.trim(F.left(head, at + 1))).otherwise(at_word(head)))

    return let(text if clean else norm(text), lambda whole: F.when(F.length(whole) <= most, whole).otherwise(let(F.substring(whole, 1, most), cut)))


def distinct_evidence(items: Column, most: int = rules.MAX_EVIDENCE) -> Column:
    """The first `most` texts of which none holds, or is held by, one taken before."""
    keyed = F.transform(items, lambda x: F.struct(x.alias("text"), compare_key(x).alias("key")))
    empty = F.array().cast("array<struct<text:string,key:string>>")
    taken = F.aggregate(
        F.filter(keyed, lambda x: x["key"] != ""),
        empty,
        lambda acc, x: F.when(
            (F.size(acc) >= most) | F.exists(acc, lambda p: F.contains(p["key"], x["key"]) | F.contains(x["key"], p["key"])), acc
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return F.transform(taken, lambda x: x["text"])
