"""Codon usage, reading and writing of codons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import _c, codon_index, rev_comp, translate_codon

FLANK = 3


def codon_usage(coding: DataFrame, organism: str = "organism", text: str = "sequence") -> DataFrame:
    """organism, codon, aa, count, fraction (among codons of its amino acid), frequency (a thousand codons).

    Counted from coding sequences read from their first base; incomplete and ambiguous codons are left out.
    """
    codons = F.explode(F.regexp_extract_all(F.upper(F.col(text)), F.lit("..."), F.lit(0)))
    rows = coding.select(organism, codons.alias("codon")).withColumn("codon", F.translate("codon", "U", "T"))
    counts = rows.where(codon_index(F.col("codon")).isNotNull()).groupBy(organism, "codon").agg(F.count(F.lit(1)).alias("count"))
    counts = counts.withColumn("aa", translate_codon("codon"))
    alike = F.sum("count").over(Window.partitionBy(organism, "aa"))
    every = F.sum("count").over(Window.partitionBy(organism))
    return counts.select(organism, "codon", "aa", "count", (F.col("count") / alike).alias("fraction"), (F.col("count") * 1000 / every).alias("frequency"))


def parse_usage(tables: DataFrame, organism: str = "organism", text: str = "text") -> DataFrame:
    """organism, codon, aa, fraction, frequency from texts of "codon fraction frequency" triples, as usage databases print them."""
    triples = F.regexp_extract_all(F.col(text), F.lit(r"([ACGTUacgtu]{3}\s+[\d.]+\s+[\d.]+)"), F.lit(1))
    rows = tables.select(organism, F.explode(triples).alias("t")).select(organism, F.split("t", r"\s+").alias("p"))
    codon = F.translate(F.upper(F.col("p")[0]), "U", "T")
    return rows.select(organism, codon.alias("codon"), translate_codon(codon).alias("aa"), F.col("p")[1].cast("double").alias("fraction"), F.col("p")[2].cast("double").alias("frequency"))


def codons_for(usage: DataFrame, organism: str = "organism") -> DataFrame:
    """usage with place: an amino acid's codons, the most used first, then by codon."""
    order = Window.partitionBy(organism, "aa").orderBy(F.desc("fraction"), "codon")
    return usage.withColumn("place", F.row_number().over(order).cast("long"))


def codon_grid(spark) -> DataFrame:
    """The 64 codons by row, column and line of the usual grid, in T, C, A, G order, with their amino acids."""
    i = F.col("id")
    base = [F.substr(F.lit("TCAG"), (F.floor(i / 4 ** (2 - k)) % 4 + 1).cast("int"), F.lit(1)) for k in range(3)]
    rows = spark.range(64).select(*[(F.floor(i / 4 ** (2 - k)) % 4).alias(c) for k, c in enumerate(("first", "second", "third"))], F.concat(*base).alias("codon"))
    return rows.withColumn("aa", translate_codon("codon"))


def codon_places(start: Column, n: Column) -> list[Column]:
    return [F.pmod(start + k, n) for k in range(3)]


def codon_at(s: Column | str, start: Column, forward: Column) -> Column:
    """The codon on its own strand of the three bases from start, around the origin if need be."""
    s = F.upper(_c(s))
    stored = F.concat(*[F.substr(s, p + 1, F.lit(1)) for p in codon_places(start, F.length(s))])
    return F.when(forward, stored).otherwise(rev_comp(stored))


def flank_case(s: Column, first: Column, last: Column) -> Column:
    """'lower' if all letters within FLANK of the codon are upper case and there is one, else 'upper': the edit stands out."""
    around = F.array(*[F.when(p >= 0, F.substr(s, F.greatest(p, F.lit(0)) + 1, F.lit(1))).otherwise("") for i in range(1, FLANK + 1) for p in (first - i, last + i)])
    text = F.array_join(around, "")
    return F.when(text.rlike("[A-Z]") & ~text.rlike("[a-z]"), "lower").otherwise("upper")


def apply_codon(s: Column | str, start: Column, forward: Column, codon: Column) -> Column:
    """s with its three bases from start replaced by a codon given on its own strand; s itself if it is not three letters."""
    s = _c(s)
    chosen = F.translate(F.upper(codon), "U", "T")
    oriented = F.when(forward, chosen).otherwise(rev_comp(chosen))
    places = codon_places(start, F.length(s))
    written = F.when(flank_case(s, places[0], places[2]) == "lower", F.lower(oriented)).otherwise(F.upper(oriented))
    out = s
    for k, p in enumerate(places):
        out = F.overlay(out, F.substr(written, F.lit(k + 1), F.lit(1)), p + 1, F.lit(1))
    return F.when(F.length(chosen) == 3, out).otherwise(s)
