"""Helpers of the operators: checked broadcasts and k-mers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side of at most this many rows and bytes is broadcast; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Places of a text that a chunk owns at least.
CHUNK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where the optimiser merges projections into a lambda that runs per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its rows and bytes are counted to be few; otherwise as it is, for a shuffled join."""
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if n <= rows and held <= BROADCAST_BYTES else df


def places(n: Column, k: int) -> Column:
    """0 .. n - k as an array, empty if n < k."""
    return F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))


def chunked(df: DataFrame, text: str, left: int, right: int, step: int = CHUNK) -> DataFrame:
    """df without text, in overlapping pieces: chunk, chunk_at (first place it owns), chunk_base (first place it holds).

    A piece owns `step` places and holds `left` and `right` letters more.  What is exploded next to it then copies a short
    piece a row, not the whole text: work is linear in the text, however long.
    """
    rest = [c for c in df.columns if c != text]

    def pieces(s: Column) -> Column:
        def one(at: Column) -> Column:
            base = F.greatest(at - left, F.lit(0))
            return F.struct(at.alias("at"), base.alias("base"), F.substr(s, base + 1, at - base + step + right).alias("text"))

        starts = F.when(F.length(s) > 0, F.sequence(F.lit(0), F.length(s) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, one)

    rows = df.select(*rest, F.explode(let(F.col(text), pieces)).alias("_c"))
    return rows.select(*rest, F.col("_c.text").alias("chunk"), F.col("_c.at").alias("chunk_at"), F.col("_c.base").alias("chunk_base"))


def kmers(df: DataFrame, text: str, k: int, left: int = 0, right: int = 0, whole: bool = False, at: str = "at", kmer: str = "kmer") -> DataFrame:
    """A row for each k-mer of df's text, with its 0-based place, in the chunk around it (see chunked); text is left out.

    whole: k-mers of all that a chunk holds, not only those it owns; the caller keeps each place once.
    """
    pieces = chunked(df, text, left, max(right, k - 1), max(CHUNK, 4 * (left + right)))
    step = max(CHUNK, 4 * (left + right))
    own = places(F.length("chunk"), k)
    if not whole:
        own = F.filter(own, lambda i: (i + F.col("chunk_base") >= F.col("chunk_at")) & (i + F.col("chunk_base") < F.col("chunk_at") + step))
    rows = pieces.select("*", F.explode(own).alias("_i"))
    return rows.withColumns({at: F.col("_i") + F.col("chunk_base"), kmer: F.substr(F.col("chunk"), F.col("_i") + 1, F.lit(k))})


def islands(df: DataFrame, by: list[str], at: str, same: list[str] | None = None) -> DataFrame:
    """Runs of consecutive values of `at` within `by`: adds run_from, run_to (a row a run).

    `same`: columns that must also be equal within a run.  Consecutive values minus their rank are constant.
    """
    from pyspark.sql import Window

    keys = by + (same or [])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    return df.withColumn("_run", F.col(at) - rank).groupBy(*keys, "_run").agg(F.min(at).alias("run_from"), F.max(at).alias("run_to")).drop("_run")
