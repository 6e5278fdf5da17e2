"""Joins of ranges that may wrap round an origin, as equi-joins on the nodes of a segment tree.

A range is cut into the few nodes of a binary tree over the places that it fills whole, at most two a level; a place
lies in one node of each level.  A place and a range that holds it meet in exactly one node, so the join gives no candidate
that isn't a match and no match twice, however long ranges are and however many start at one place.  Two ranges overlap if
one holds the other's start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of the tree: places are below 2 ** LEVELS.
LEVELS = 40


def pieces(start: Column, end: Column, length: Column | None = None) -> Column:
    """A range (0-based, inclusive) as straight ones; with end before start it goes round a circle of `length` places."""
    straight = F.struct(start.cast("long").alias("a"), end.cast("long").alias("b"))
    none = F.array().cast("array<struct<a: long, b: long>>")
    if length is None:
        return F.when(start <= end, F.array(straight)).otherwise(none)
    tail = F.struct(start.cast("long").alias("a"), (length - 1).cast("long").alias("b"))
    head = F.struct(F.lit(0).cast("long").alias("a"), end.cast("long").alias("b"))
    return F.when(start <= end, F.array(straight)).when((end < start) & (start < length), F.array(tail, head)).otherwise(none)


def _up(x: Column, level: Column) -> Column:
    """The node of a level in which a place lies."""
    return F.call_function("shiftright", x, level)


def nodes(a: Column, b: Column, levels: int = LEVELS) -> Column:
    """The nodes (level, node) that a straight range fills whole and whose parents it doesn't; places are below 2 ** levels."""

    def at(level: Column) -> Column:
        low = _up(a + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
        high = _up(b + 1, level)
        node = lambda x: F.struct(level.alias("level"), x.alias("node"))
        left = F.when((low < high) & (low % 2 == 1), F.array(node(low))).otherwise(F.array().cast("array<struct<level: int, node: long>>"))
        right = F.when((low < high) & (high % 2 == 1), F.array(node(high - 1))).otherwise(F.array().cast("array<struct<level: int, node: long>>"))
        return F.array_union(left, right)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def held(points: DataFrame, ranges: DataFrame, by: list[str], place: str, start: str = "start", end: str = "end", length: str | None = None, levels: int = LEVELS) -> DataFrame:
    """points and ranges joined where a range holds a point's place, within `by`; their other columns must differ in name.

    levels: all places of ranges are below 2 ** levels; a point is a row for each.
    length: the column of ranges with the places of its circle, if ranges may wrap.  Null places, ends and keys meet nothing;
    repeated rows meet each for itself.
    """
    size = F.col(length) if length else None
    cut = ranges.select("*", F.explode(pieces(F.col(start), F.col(end), size)).alias("_piece"))
    filled = cut.select("*", F.explode(nodes(F.col("_piece.a"), F.col("_piece.b"), levels)).alias("_n")).drop("_piece")
    filled = filled.select(*(F.col(c).alias(f"_by_{c}") if c in by else F.col(c) for c in ranges.columns), F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node"))
    spot = F.col(place).cast("long")
    path = F.when(spot >= 0, F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda x: F.struct(x.alias("level"), _up(spot, x).alias("node"))))
    asked = points.select("*", F.explode(path).alias("_at"))
    same = [F.col(c) == F.col(f"_by_{c}") for c in by]
    on = (F.col("_at.level") == F.col("_level")) & (F.col("_at.node") == F.col("_node"))
    for c in same:
        on = on & c
    # A side's bytes on disk say little about its rows here, of which each is exploded: it is never sent to the driver and broadcast.
    return asked.join(filled.hint("merge"), on).drop("_at", "_level", "_node", *(f"_by_{c}" for c in by))


def overlapping(left: DataFrame, right: DataFrame, by: list[str], length: str | None = None, levels: int = LEVELS) -> DataFrame:
    """Pairs of ranges of left and right that have a place in common, within `by`.

    Both have start and end, and, if ranges may wrap, a column `length`, the same in all rows of a key; the result has by, left's
    columns with l_ and right's with r_ before their names.  Ranges whose start is beyond the circle, or that are empty, meet none.
    """
    named = lambda df, p: df.select(*(F.col(c) if c in by else F.col(c).alias(f"{p}{c}") for c in df.columns))
    size = f"{{}}{length}" if length else None
    lefts, rights = named(left, "l_"), named(right, "r_")
    real = lambda df, p: df.where(F.size(pieces(F.col(f"{p}start"), F.col(f"{p}end"), F.col(size.format(p)) if size else None)) > 0)
    lefts, rights = real(lefts, "l_"), real(rights, "r_")
    one = held(lefts, rights, by, "l_start", "r_start", "r_end", size and size.format("r_"), levels)
    other = held(rights, lefts, by, "r_start", "l_start", "l_end", size and size.format("l_"), levels).where("l_start <> r_start")
    # Two that go round the circle may each hold the other's start: such a pair is kept once.
    a, b, x = F.col("r_start"), F.col("r_end"), F.col("l_start")
    again = F.when(a <= b, x.between(a, b)).otherwise((x >= a) | (x <= b))
    return one.unionByName(other.where(~again))
