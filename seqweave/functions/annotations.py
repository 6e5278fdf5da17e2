"""Locations of annotations on circular sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def restates_origin(locations: Column, start: Column, end: Column, n: Column) -> Column:
    """Whether two locations say no more than that the range crosses the origin."""
    a, b = F.try_element_at(locations, F.lit(1)), F.try_element_at(locations, F.lit(2))
    head_first = a["start"] == 0
    tail, head = F.when(head_first, b).otherwise(a), F.when(head_first, a).otherwise(b)
    same = (tail["start"] == start) & (tail["end"] == n - 1) & (head["start"] == 0) & (head["end"] == end)
    return F.coalesce((F.size(locations) == 2) & (end < start) & (n > 0) & same, F.lit(False))


def restore_locations(locations: Column, start: Column, end: Column, n: Column) -> Column:
    """The two locations of a range that crosses the origin and has none; others as they are."""
    none = locations.isNull() | (F.size(locations) == 0)
    both = F.array(F.struct(start.alias("start"), (n - 1).alias("end")), F.struct(F.lit(0).alias("start"), end.alias("end")))
    return F.when((end < start) & none, both).otherwise(locations)
