"""Tables of primer hits as they are shown: which columns, what they say, which rows a text filter keeps.

hits: name, sequence, strand, three_prime, wraps, anneal, overhang, tm, and extra, a map of the inventory's other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that a table of hits can't do without, and those that it has unless others are chosen, in the order shown.
LOCKED = ("pos", "str", "name")
USUAL = ("pos", "str", "name", "tm", "anneal", "tail")
WRAPS, NONE, MINUS = "↩", "—", "−"


def visible(extra: list[str], chosen: list[str] | None = None, alias: str | None = None) -> list[str]:
    """The columns shown: locked ones, then those chosen, or by default the usual ones and the alias; in table order."""
    wanted = set(chosen) if chosen is not None else {*USUAL, *([alias] if alias else [])}
    return [c for c in (*USUAL, *extra) if c in LOCKED or c in wanted]


def shown(column: str) -> Column:
    """What a column says of a hit."""
    return {
        "pos": F.concat((F.col("three_prime") + 1).cast("string"), F.when(F.col("wraps"), WRAPS).otherwise("")),
        "str": F.when(F.col("strand") == 1, "+").otherwise(MINUS),
        "name": F.when(F.coalesce(F.col("name"), F.lit("")) == "", "(unnamed)").otherwise(F.col("name")),
        "tm": F.coalesce(F.col("tm").cast("string"), F.lit(NONE)),
        "anneal": F.col("anneal").cast("string"),
        "tail": F.when(F.col("overhang") > 0, F.concat(F.lit("+"), F.col("overhang").cast("string"))).otherwise(NONE),
    }.get(column, F.coalesce(F.try_element_at("extra", F.lit(column)), F.lit("")))


def table(hits: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """The columns of visible() as texts, after those to keep as they are."""
    return hits.select(*(keep or []), *[shown(c).alias(c) for c in columns])


def text_filter(hits: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Hits whose name, sequence or a shown column of the inventory holds the text, whatever the case; all for a blank text."""
    wanted = text.strip().lower()
    if not wanted:
        return hits
    places = [F.col("name"), F.col("sequence"), *[F.try_element_at("extra", F.lit(c)) for c in columns if c not in USUAL]]
    found = F.lit(False)
    for p in places:
        found = found | F.contains(F.lower(F.coalesce(p, F.lit(""))), F.lit(wanted))
    return hits.where(found)
