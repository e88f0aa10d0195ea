"""Line dedup with at most one edit, by a segment-partition join; DataFrame operations only.

With a threshold of one edit, a line is cut into two segments, one of which a similar
line of the same or the next length holds unchanged at a known place. Each line puts its
segments into an index by (length, segment), and probes that of its own length and of
the length below. Pairs that meet are verified by a banded bit-parallel edit distance.

Where many lines share a segment, no pairs are made. The other half of each line is cut
into holes of HOLE characters; the one edit lies in one of them, and what stands left and
right of it must agree. Inside such a group, lines that are equal but for one character
of the hole form a star, and a line meets the longer ones that are it with one character
more. Both are found by keys of the hole without one character, so that there are at
most HOLE + 1 links for each line and hole. Linked lines form classes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import let, with_computed
from .common import among, checkpointed, row_key, saved
from .components import connected_components

LEAST_LENGTH = 8
EDITS = 1
HOT = 48
HOLE = 8


def _rows(docs: DataFrame) -> DataFrame:
    """(row, id, pos, line): the distinct lines with a word of each row, by first place."""
    lines = F.array_distinct(F.split("text", "\n"))
    rows = docs.select(row_key("doc_id", "text").alias("row"), F.col("doc_id").alias("id"), F.posexplode(lines).alias("pos", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _place() -> Column:
    """The order of occurrences: by doc_id (null last), row and place."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "pos")


def _part(line: Column, start: Column, n: Column) -> Column:
    return F.substring(line, start, n)


def _segment(role: int, side: int) -> Column:
    """Key of a line's first (side 1) or second segment: its index row (role 0), or its probe of the length below."""
    n, line = F.length("line"), F.col("line")
    length = n - role
    half = F.floor(length / 2).cast("int")
    part = _part(line, F.lit(1), half) if side == 1 else _part(line, half + 1 + role, n)
    return F.when(n >= LEAST_LENGTH, F.xxhash64(length, F.lit(side), part))


#: Columns of a line's keys; kind % 2 is the role and kind // 2 the side.
_KINDS = {"k2": (0, 1), "k3": (1, 1), "k4": (0, 2), "k5": (1, 2)}


def _holes() -> Column:
    """(group, hole) for each hole in a line's other half than the segment that `kind` names."""
    n, role = F.length("line"), (F.col("kind") % 2).cast("int")
    length = n - role
    half = F.floor(length / 2).cast("int")
    first = F.col("kind") < 4
    lo = F.when(first, half).otherwise(F.lit(0))
    hi = F.when(first, length).otherwise(half)

    def hole(a: Column) -> Column:
        end = F.least(a + HOLE, hi) + role
        group = F.xxhash64(F.col("key"), a, _part(F.col("line"), F.lit(1), a), _part(F.col("line"), end + 1, n))
        return F.struct(group.alias("group"), _part(F.col("line"), a + 1, end - a).alias("hole"))

    return F.transform(F.sequence(lo, F.greatest(lo, hi - 1), F.lit(HOLE)), hole)


def _shortened() -> Column:
    """(at, rest) for each character of the hole: its place and the hole without it."""
    without = lambda d: F.concat(_part(F.col("hole"), F.lit(1), d - 1), _part(F.col("hole"), d + 1, F.length("hole")))
    return F.transform(F.sequence(F.lit(1), F.length("hole")), lambda d: F.struct(d.alias("at"), without(d).alias("rest")))


def _hot_links(hot: DataFrame) -> DataFrame:
    """Links (a, b) inside hot segments, from rows of (h, key, kind, line); their number is in proportion to the rows."""
    fine = hot.select("h", (F.col("kind") % 2).alias("role"), F.inline(_holes()))
    roles = fine.groupBy("group").agg(F.count_if(F.col("role") == 0).alias("n0"), F.count_if(F.col("role") == 1).alias("n1"))
    fine = checkpointed(fine.join(roles.where("n0 > 1 or n0 = 1 and n1 > 0"), "group").select("group", "role", "h", "hole", "n0"))
    # another character in one place: all lines of a node are one edit apart
    other = fine.where("role = 0 and n0 > 1").select("h", "group", F.inline(_shortened()))
    other = other.select("h", F.xxhash64("group", "at", "rest").alias("node"))
    least = other.groupBy("node").agg(F.min("h").alias("b"), F.count("*").alias("n")).where("n > 1").select("node", "b")
    swapped = other.join(least, "node").where("h <> b").select(F.col("h").alias("a"), "b")
    # one character more: the longer line without it is the shorter one
    longer = fine.where("role = 1").select(F.col("h").alias("a"), "group", F.inline(_shortened())).select("a", F.xxhash64("group", "rest").alias("node"))
    shorter = fine.where("role = 0").select(F.col("h").alias("b"), F.xxhash64("group", "hole").alias("node"))
    return swapped.unionByName(longer.join(shorter, "node").select("a", "b"))


def _pairs(rows: DataFrame) -> DataFrame:
    """(a, b) that share a key, b as an index row, from rows of (key, kind, h) of which at most HOT index rows share one."""
    index = rows.where("kind % 2 = 0").select("key", F.col("h").alias("b"))
    near = rows.select("key", "kind", F.col("h").alias("a")).join(index, "key")
    return near.where("a <> b and (kind % 2 = 1 or a > b)").select("a", "b")


def within(pairs: DataFrame, x: str, y: str, edits: int = EDITS) -> DataFrame:
    """The rows of pairs whose texts x and y are at most so many edits apart, by a banded bit-parallel edit distance.

    A column of the distance table is kept for 2 * edits + 1 rows around the diagonal,
    as bits for a rise and a fall between neighbouring rows. A character of y makes the
    next column by a few operations on words; whether the cost rises on the diagonal
    that ends in the last cell is one bit of each column.
    """
    width = 2 * edits + 1
    mask, one, none = (F.lit(v).cast("long") for v in ((1 << width) - 1, 1, 0))
    left, right = (lambda v: F.shiftleft(v, 1).bitwiseAND(mask)), (lambda v: F.shiftrightunsigned(v, 1))
    invert = lambda v: v.bitwiseXOR(mask)

    def equal(j: Column) -> Column:
        bits = [F.when(F.get("a", j - edits + k) == F.get("b", j), F.lit(1 << k).cast("long")).otherwise(none) for k in range(width)]
        return reduce(Column.bitwiseOR, bits)

    def step(s: Column, eq: Column) -> Column:
        def diagonal(q: Column) -> Column:
            d0 = ((eq.bitwiseAND(q["up"]) + q["up"]).bitwiseXOR(q["up"])).bitwiseOR(eq).bitwiseOR(q["down"]).bitwiseAND(mask)
            return F.struct(d0.alias("d0"), q["up"].alias("up"), q["down"].alias("down"))

        def advance(q: Column) -> Column:
            rise = left(q["down"].bitwiseOR(invert(q["d0"].bitwiseOR(q["up"]))))
            up = left(q["d0"].bitwiseAND(q["up"])).bitwiseOR(invert(q["d0"].bitwiseOR(rise)))
            end = F.call_function("shiftright", q["d0"], s["end"]).bitwiseAND(one)
            return F.struct(up.alias("up"), q["d0"].bitwiseAND(rise).alias("down"), (s["cost"] + one - end).alias("cost"), s["end"].alias("end"))

        return let(let(F.struct(right(s["up"]).alias("up"), right(s["down"]).alias("down")), diagonal), advance)

    n, m = F.length(x), F.length(y)
    rows = with_computed(pairs.where(F.abs(n - m) <= edits), {"a": F.split(x, ""), "b": F.split(y, "")})
    rows = with_computed(rows, {"eq": F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), equal)).otherwise(F.array().cast("array<bigint>"))})
    # before the first column, rows from 1 on rise by one each
    start = F.struct(F.lit(((1 << edits) - 1) << (edits + 1)).cast("long").alias("up"), none.alias("down"), F.greatest(n - m, F.lit(0)).cast("long").alias("cost"), (n - m + edits).alias("end"))
    return rows.where(F.aggregate("eq", start, step, lambda s: s["cost"]) <= edits).drop("a", "b", "eq")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, line) of the lines in wanted (h); nearly all others are dropped before the exchange, and copies of a common line put together."""
    near = among(rows.select(F.xxhash64("line").alias("h"), "line"), "h", wanted)
    return near.groupBy("h").agg(F.min("line").alias("line")).join(wanted, "h", "left_semi")


def similar_lines(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Links (a, b) that join the lines which single edits turn into each other.

    rows: all occurrences with their text; lines: the keys of each distinct line.
    """
    keyed = F.array(*(F.struct(F.col(k).alias("key"), F.lit(int(k[1:])).alias("kind")) for k in _KINDS))
    keys = lines.where("k2 is not null").select("h", F.explode(keyed).alias("x")).select("x.key", "x.kind", "h")
    hot = keys.where("kind % 2 = 0").groupBy("key").count().where(F.col("count") > HOT).select("key", F.lit(True).alias("hot"))
    marked = keys.join(hot, "key", "left")
    cold = checkpointed(_pairs(marked.where("hot is null")).distinct())
    again = marked.where("hot").select("h", "key", "kind")
    wanted = cold.select(F.col("a").alias("h")).unionByName(cold.select(F.col("b").alias("h"))).unionByName(again.select("h")).distinct()
    texts = saved(_texts(rows, checkpointed(wanted)))
    left, right = texts.select(F.col("h").alias("p"), F.col("line").alias("x")), texts.select(F.col("h").alias("q"), F.col("line").alias("y"))
    met = cold.select(F.col("a").alias("p"), F.col("b").alias("q")).join(left, "p").join(right, "q")
    near = within(met, "x", "y").select(F.col("p").alias("a"), F.col("q").alias("b"))
    return near.unionByName(_hot_links(again.join(texts, "h")))


def line_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences (h, row, id, pos), and (h, first) for each distinct line that recurs or has a similar one.

    first is the place (row, pos) of the first occurrence of the line's class. Text is
    read for the keys and for the candidates; all else is numbers.
    """
    occurs = saved(rows.select(F.xxhash64("line").alias("h"), "row", "id", "pos", *(_segment(*v).alias(k) for k, v in _KINDS.items())))
    lines = saved(occurs.groupBy("h").agg(F.min(_place()).alias("place"), (F.min("row") < F.max("row")).alias("again"), *(F.min(k).alias(k) for k in _KINDS)))
    comps = connected_components(similar_lines(rows, lines)).withColumnRenamed("node", "h")
    known = lines.select("h", "place", "again").join(comps, "h", "left").where("again or component is not null")
    known = known.select("h", "place", F.coalesce("component", "h").alias("class"))
    best = known.groupBy("class").agg(F.min("place").alias("first"))
    return occurs.select("h", "row", "pos"), known.join(best, "class").select("h", F.col("first.row").alias("first_row"), F.col("first.pos").alias("first_pos"))


def without(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs without the lines at the places (row, pos) of repeated, pos among a row's distinct lines; as dedup_lines() returns them."""
    gone = repeated.groupBy("row").agg(F.collect_list("pos").alias("gone"))
    full = docs.select(row_key("doc_id", "text").alias("row"), F.struct("*").alias("doc")).join(gone, "row", "left")
    text = F.coalesce(F.col("doc")["text"], F.lit(""))
    full = full.select("doc", "gone", F.when(text != "", F.split(text, "\n")).otherwise(F.array().cast("array<string>")).alias("lines"))
    # blank lines get a number, so that the distinct others can be told from them
    blank = F.transform("lines", lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), x).otherwise(F.concat(F.lit("\0"), i.cast("string"), F.lit("\0"), x)))
    # distinct lines are worked out once a row; what follows works by hashing, so cost grows with the lines and not with their pairs
    full = with_computed(full, {"distinct": F.array_distinct("lines")})
    held = F.array_except(blank, F.transform(F.coalesce("gone", F.array().cast("array<int>")), lambda p: F.get("distinct", p)))
    full = full.select("doc", F.size("lines").cast("long").alias("n"), held.alias("kept"))
    text = F.array_join(F.transform("kept", lambda x: F.when(x.startswith("\0"), F.regexp_replace(x, "^\0[0-9]+\0", "")).otherwise(x)), "\n")
    keep = [F.col("doc")[c].alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_removed", "text")]
    return full.select(*keep, text.alias("text"), F.col("n").alias("n_lines"), (F.col("n") - F.size("kept")).alias("n_removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text without repeated lines, and n_lines and n_removed.

    A class is a line with all that single edits reach from it (lines under
    LEAST_LENGTH characters: equal ones only); its first occurrence stays, and the
    others go, within a document too. First is by doc_id, null ones last, then by a
    hash of doc_id and text, then by place. Rows that share a doc_id, or have none,
    are documents of their own; rows that are equal in doc_id and text count as one,
    and each keeps what that one keeps. Lines without a word stay. Null text counts as
    empty (no line, text ''). All other columns stay, whatever their names; columns
    named n_lines or n_removed are replaced. An empty table gives an empty one. Lines
    meet by 64-bit hashes; pairs that share a segment are verified on their text.
    """
    occurs, firsts = line_classes(_rows(docs))
    return without(docs, occurs.join(firsts, "h").where("row <> first_row or pos <> first_pos").select("row", "pos"))
