"""Sequence workloads projected from the driver's general tables.

Texts keep only their A, C, G and T, so prose becomes nucleotides; both engines agree on the projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = "upper(regexp_replace({}, '[^ACGTacgt]+', ''))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scanned table over all cores, if its files make fewer tasks than there are: work a row outweighs one shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, file, name, sequence, circular."""
    rows = spread(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file"), F.col("source").alias("name"),
        F.expr(BASES.format("text")).alias("sequence"), (F.col("doc_id") % 2 == 0).alias("circular"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, sequence."""
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(F.col("item_id").alias("query_id"), F.expr(BASES.format("text")).alias("sequence"))


#: The same in DuckDB, as common table expressions.
CORPUS_SQL = """corpus AS (
  SELECT doc_id, 'doc' || doc_id AS file, source AS name, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS sequence,
         doc_id % 2 = 0 AS circular FROM documents)"""
QUERIES_SQL = """queries AS (
  SELECT item_id AS query_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS sequence FROM benchmark)"""
