"""The k-mer index over the whole corpus as a query, after files have changed and gone; SQL scans the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import scratch
from ..streaming import index
from .search_plans import STRANDS_SQL
from .workloads import CORPUS_SQL, QUERIES_SQL, corpus, queries


def kmer_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text is first taken in reversed, next to a file that goes; then as it is; the index is compacted and searched."""
    folder = scratch(spark, "index")
    rows = corpus(spark, sf_dir).select(F.col("file").alias("path"), F.timestamp_seconds(F.lit(2)).alias("mtime"), F.length("sequence").alias("size"), F.coalesce("sequence", F.lit("")).alias("sequence"))
    before = rows.withColumns({"mtime": F.timestamp_seconds(F.lit(1)), "sequence": F.reverse("sequence")})
    leaving = rows.withColumn("path", F.concat(F.lit("leaving/"), "path"))
    index.upsert(before.union(leaving), folder)
    index.upsert(rows.union(leaving.withColumn("sequence", F.lit(None).cast("string"))), folder)
    index.compact(spark, folder)
    index.vacuum(spark, folder)
    return index.search(spark, folder, queries(spark, sf_dir))


INDEX_SQL = f"""
WITH {CORPUS_SQL}, {QUERIES_SQL}, {STRANDS_SQL},
places AS (
  SELECT c.file, c.sequence, p.*, unnest(range(0, greatest(0, length(c.sequence) - length(p.probe) + 1))) AS pos
  FROM corpus c JOIN probes p ON contains(c.sequence, p.probe) AND p.probe <> '')
SELECT query_id, file AS path, pos::BIGINT AS start, (pos + length(probe) - 1)::BIGINT AS "end", strand
FROM places WHERE substr(sequence, (pos + 1)::INT, length(probe)) = probe
"""

QUERIES = {"kmer_index_search": (kmer_index_search, INDEX_SQL)}
