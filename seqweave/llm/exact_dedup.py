"""Exact deduplication by a tree-merge of sorted digest runs.

Every text is reduced to a digest once.  Rows are dealt into 2 ** RUN_BITS runs and each run is sorted by digest; where
rows of a digest meet, the best row stays with the count of all.  Then partitions exchange runs in binomial rounds: in
each, the runs whose numbers differ in the next ROUND_BITS bits meet, a slice of the digests in each task, and are merged
in digest order, keeping the best of each digest again, until one run is left.  A digest's rows meet 2 ** ROUND_BITS at a
time, so a text that a third of all rows share costs no task more than another, and as runs lie in slices of the digests
the last one is spread over all tasks.

Equality is verified at every level: rows are one only if SHA-256, an independent 64-bit hash and the length, all of the
normalised text, agree.

Defined results: a null text counts as empty; empty texts are copies of each other; among ties in length the smallest
doc_id stays and a null doc_id counts as the largest; repeated rows with one doc_id all carry that id, and only rows
with keep_id = doc_id are kept, one of them for each group if ids repeat (`deduplicate`); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Runs that the rows are dealt into, as bits; and bits merged a round.
RUN_BITS, ROUND_BITS = 8, 4
#: Hex digits of the digest that name a slice of a run.
SLICE_DIGITS = 4
KEY = ("text_sha256", "bytes", "hash")
#: Of rows with one digest the first in this order stays.
ORDER = ("shorter", "no_id", "doc_id")


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, common.SPACE, "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, length, and the digest columns of each row, written once: the only pass over the texts."""
    text = common.text_of()
    slim = docs.select("doc_id", F.length(text).cast("long").alias("length"), normalised(text).alias("n"))
    return common.written(
        slim.select(
            "doc_id",
            "length",
            F.sha2(F.col("n").cast("binary"), 256).alias("text_sha256"),
            F.struct(F.octet_length("n").alias("bytes"), F.xxhash64("n").alias("hash")).alias("proof"),
        ).select("doc_id", "length", "text_sha256", "proof.bytes", "proof.hash"),
        "digests",
    )


def merged_runs(rows: DataFrame) -> DataFrame:
    """Rows with one run number merged to one sorted run: of each digest the first row in ORDER, with the sum of n.

    A task holds slices of runs in digest order, so a digest's rows are neighbours there.
    """
    where = ["run", "slice"]
    met = rows.repartition(*where).sortWithinPartitions(*where, *KEY, *ORDER)
    neighbours = Window.partitionBy(*where, *KEY).orderBy(*ORDER)
    first = met.withColumn("place", F.row_number().over(neighbours))
    first = first.withColumn("n", F.sum("n").over(neighbours.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return first.where("place = 1").drop("place")


def merge_runs(slim: DataFrame, run_bits: int = RUN_BITS, round_bits: int = ROUND_BITS) -> DataFrame:
    """One row a distinct text: digest columns, keep_id, group_size."""
    dealt = F.xxhash64("doc_id", "length", F.spark_partition_id())  # repeated rows go to several runs too
    rows = slim.select(
        *KEY, (-F.col("length")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", F.lit(1).cast("long").alias("n"),
        F.pmod(dealt, F.lit(1 << run_bits)).alias("run"), F.substring("text_sha256", 1, SLICE_DIGITS).alias("slice"),
    )
    rows = merged_runs(rows)
    left = run_bits
    while left > 0:
        step = min(round_bits, left)
        rows = merged_runs(rows.withColumn("run", F.shiftright("run", step)))
        left -= step
    return rows.select(*KEY, F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    slim = digests(docs)
    # A written table claims no partitioning, so the join shuffles both sides and a hot digest's rows can be split.
    merged = common.written(merge_runs(slim), "merged")
    found = slim.join(merged, list(KEY))
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns: whole documents, one a distinct text.

    Rows that repeat a doc_id and its text come once; which one is open only if their other columns differ.
    """
    kept = exact_dedup(docs).where("kept").select(_row_key("doc_id").alias("__sw_key"), F.col("text_sha256").alias("__sw_sha"))
    own = docs.withColumns({"__sw_key": _row_key("doc_id"), "__sw_sha": F.sha2(normalised(common.text_of()).cast("binary"), 256)})
    # Repeated rows are one before they are shuffled, and both steps need rows by (__sw_key, __sw_sha): texts move once.
    out = own.dropDuplicates(["__sw_key", "__sw_sha"]).join(kept.distinct(), ["__sw_key", "__sw_sha"], "left_semi")
    return out.select(*docs.columns)


def _row_key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))
