"""Mixing sources to target weights.

Every document gets a hash-random key.  Within a source the documents are ranged by that key, running sums of word
counts are taken over the ranges, and the source is cut at its exact budget; a budget above the source's size is met by
whole epochs first.  All of it is DataFrame expressions; texts are read once, to be counted, and never shuffled.

Running sums are taken at three levels: over coarse key ranges of a source, over fine ranges of a coarse one, and over
documents of a fine one.  Keys are uniform, so the number of ranges sets the rows that meet in one task, however large
a source is.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source of its own, weighted last;
repeated rows count each; an empty table gives no rows; columns other than doc_id, source and text are ignored by
`mix_plan` and kept by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents that meet in one fine range, about.
RANGE_ROWS = 250
#: Fine ranges that meet in one coarse range, about.
RANGES_A_COARSE = 256
CYCLE = (1, 2, 3)
MAX_EPOCHS = 3


def key_of(seed: str) -> Column:
    """A hash-random key of 32 hex digits, of doc_id and text, so that rows of one id are spread too.

    The same rows get the same keys on every run and engine.
    """
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(common.text_of().cast("binary"))]
    return F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))


def source_key() -> Column:
    """The source as a key that is never null: '' stands for the null source."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """(src, source_size) with target added: one row a source, as many rows as there are sources.

    Shares follow the weights; a target stops at max_epochs times the source and the excess is reshared by weight.
    That fixed point is water-filling: with sources ordered by cap per weight, those before the water level get their
    cap and the rest their weight times the level.
    """
    n = len(cycle)
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy((F.col("src") == "").asc(), "src")
    ranked = sizes.withColumn("i", F.row_number().over(by_name) - 1)
    weights = F.array(*[F.lit(w) for w in cycle])
    ranked = ranked.withColumn("w", F.element_at(weights, (F.col("i") % n + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs)
    before = everything.orderBy((F.col("cap") / F.col("w")).asc(), "i").rowsBetween(Window.unboundedPreceding, -1)
    left = ranked.withColumn("budget", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    left = left.withColumn("rest", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    level = left.withColumn("level", F.col("budget") / F.col("rest"))
    level = level.withColumn("open", F.col("w") * F.col("level") < F.col("cap"))
    water = F.max(F.when(F.col("open"), F.col("level"))).over(everything)
    found = level.withColumn("water", water)
    target = F.when(F.col("open"), F.col("w") * F.col("water")).otherwise(F.col("cap").cast("double"))
    return found.select("src", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, seed: str = "mix", max_epochs: int = MAX_EPOCHS, cut: str = "word") -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document.

    cut="word" stops inside a document, so a source's taken words are its target's floor; cut="document" takes the
    last document whole if most of it fits.
    """
    slim = docs.select(
        "doc_id", "source", common.word_count(common.text_of()).alias("size"), key_of(seed).alias("key")
    )
    slim = common.written(slim.withColumn("src", source_key()), "mix")
    rows = slim.count()
    fine = max(1, -(-rows // RANGE_ROWS))
    at = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    ranged = slim.withColumn("fine", F.floor(at * fine / F.lit(1 << 32)).cast("long"))
    ranged = ranged.withColumn("coarse", F.floor(F.col("fine") / RANGES_A_COARSE).cast("long"))

    by_fine = ranged.groupBy("src", "coarse", "fine").agg(F.sum("size").alias("fine_size"))
    by_coarse = by_fine.groupBy("src", "coarse").agg(F.sum("fine_size").alias("coarse_size"))
    sizes = by_coarse.groupBy("src").agg(F.sum("coarse_size").alias("source_size"))

    def running(what: str, group: list[str], order: list[str]) -> Column:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(what).over(w), F.lit(0))

    coarse = by_coarse.withColumn("coarse_at", running("coarse_size", ["src"], ["coarse"])).drop("coarse_size")
    starts = by_fine.withColumn("fine_at", running("fine_size", ["src", "coarse"], ["fine"]))
    starts = starts.join(coarse, ["src", "coarse"]).join(targets(sizes, max_epochs), "src")
    starts = starts.select("src", "fine", (F.col("coarse_at") + F.col("fine_at")).alias("start"), "source_size", "target")

    within = ranged.withColumn("inside", running("size", ["src", "fine"], ["key", "doc_id", "size"]))
    placed = within.join(starts, ["src", "fine"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    room = budget - epochs * F.col("source_size") - F.col("start") - F.col("inside")
    if cut == "word":
        last = F.greatest(F.lit(0), F.least(F.col("size"), room))
    else:
        last = F.when(2 * room >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    taken = (epochs * F.col("size") + last).cast("long")
    return placed.select("doc_id", "source", "key", "src", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, seed: str = "mix", max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed documents: a row for each time a document is taken, with the columns of docs.

    Documents stay whole here, so a source misses its target by half a document at most.  Empty documents are not taken.
    Of rows alike in doc_id, source and text, those that come first in some order are taken more often, if they can't all
    be as often.
    """
    plan = mix_plan(docs, seed, max_epochs, cut="document")
    alike = plan.groupBy(F.col("key").alias("__sw_key"), F.col("src").alias("__sw_src"))
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    copies = alike.agg(F.sum(times).alias("__sw_copies"), F.count(F.lit(1)).alias("__sw_rows")).where("__sw_copies > 0")
    joined = docs.withColumns({"__sw_key": key_of(seed), "__sw_src": source_key()}).join(copies, ["__sw_key", "__sw_src"])
    place = F.row_number().over(Window.partitionBy("__sw_key", "__sw_src").orderBy(F.lit(0)))
    more = (F.col("__sw_place") <= F.col("__sw_copies") % F.col("__sw_rows")).cast("long")
    own = joined.withColumn("__sw_place", place).withColumn("__sw_n", F.floor(F.col("__sw_copies") / F.col("__sw_rows")) + more)
    return own.where("__sw_n > 0").withColumn("__sw_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__sw_n")))).select(*docs.columns)
