"""Text sinks: spreadsheets of items, tab-separated copies, sequence lists, FASTA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import coordinates, strand_word

# Columns of the exported sheet.
HEADERS = ("Name", "Sequence", "Length", "Tm (°C)", "Source plasmid", "Coordinates", "Strand", "In inventory", "Note")
BOM, EOL = "﻿", "\r\n"


def csv_field(c: Column) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def inventory_cell() -> Column:
    named = F.when(F.col("match_name") != "", F.col("match_name")).otherwise("yes")
    return F.when(F.col("match_status").isNull(), "").when(F.col("match_status") == "unknown", "unknown").when(F.col("found"), named).otherwise("new")


def number_text(c: Column) -> Column:
    """A double the shortest way: no '.0'."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def csv_lines(items: DataFrame) -> DataFrame:
    """items with line: name, sequence, length, tm, source, coordinates, strand, inventory, note, quoted where needed."""
    cells = [
        F.col("name"), F.col("sequence"), F.length("sequence"), number_text(F.col("tm")), F.col("source_name"),
        coordinates("start", "end", F.col("wraps")), strand_word("strand"), inventory_cell(), F.col("note"),
    ]
    return items.withColumn("line", F.concat_ws(",", *[csv_field(c) for c in cells]))


def csv_header() -> str:
    return BOM + ",".join(HEADERS)


def tsv_lines(items: DataFrame) -> DataFrame:
    """items with line: name and sequence, white space that would break the table made one space."""
    clean = [F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[\t\r\n]+", " ") for c in ("name", "sequence")]
    return items.withColumn("line", F.concat_ws("\t", *clean))


def write_lines(lines: DataFrame, path: str, order: list[str], header: str | None = None, eol: str = "\n") -> None:
    """One text file of `line` in the given order, as sheets need.  Large exports should be partitioned by a key instead."""
    rows = lines.select(*order, "line")
    if header is not None:
        rows = rows.select(F.lit(1).alias("_h"), *order, "line").union(
            rows.limit(0).select(F.lit(0).alias("_h"), *order, "line").sparkSession.range(1).select(
                F.lit(0).alias("_h"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order], F.lit(header).alias("line")))
        order = ["_h", *order]
    rows.repartitionByRange(1, *order).sortWithinPartitions(*order).select("line").write.option("lineSep", eol).text(path)
