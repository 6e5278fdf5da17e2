"""Queries of the primer operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import primers as P
from .scalar_plans import tm_sql
from .search_plans import REV
from .workloads import CORPUS_SQL, QUERIES_SQL, corpus, queries


def _primers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's sequences as an inventory; odd ones carry a lower-case tail that does not anneal."""
    q = queries(spark, sf_dir)
    tail = F.when(F.col("query_id") % 2 == 1, F.lit("ggggccccttttaaaa")).otherwise("")
    return q.select(F.col("query_id").alias("ord"), F.concat(F.lit("p"), F.col("query_id").cast("string")).alias("name"), F.concat(tail, "sequence").alias("sequence"))


PRIMERS_SQL = f"""{QUERIES_SQL},
primers AS (SELECT * FROM (SELECT query_id AS ord, 'p' || query_id AS name, upper(CASE WHEN query_id % 2 = 1 THEN 'ggggccccttttaaaa' ELSE '' END || sequence) AS s FROM queries)
  WHERE length(s) >= 12),
oriented AS (
  SELECT ord, name, 1 AS strand, s AS q, substr(s, (length(s) - 11)::INT) AS anchor FROM primers
  UNION ALL SELECT ord, name, -1, {REV.format("s")}, substr({REV.format("s")}, 1, 12) FROM primers),
padded AS (SELECT file, length(sequence) AS n, sequence || CASE WHEN circular AND sequence <> ''
  THEN substr(sequence, 1, least((SELECT max(length(s)) FROM primers) - 1, length(sequence) - 1)::INT) ELSE '' END AS t FROM corpus),
places AS (SELECT file, n, t, unnest(range(0, greatest(0, length(t) - 11))) AS pos FROM padded),
anchored AS (SELECT p.*, o.* FROM places p JOIN oriented o ON substr(t, (pos + 1)::INT, 12) = anchor),
reached AS (SELECT *, CASE WHEN strand = 1 THEN
    list_transform(range(1, least(pos, length(q) - 12) + 1), lambda j: substr(t, (pos - j + 1)::INT, 1) = substr(q, (length(q) - 12 - j + 1)::INT, 1))
  ELSE list_transform(range(1, greatest(0, least(length(t) - pos - 12, length(q) - 12)) + 1), lambda j: substr(t, (pos + 12 + j)::INT, 1) = substr(q, (12 + j)::INT, 1)) END AS same FROM anchored),
annealed AS (SELECT *, 12 + CASE WHEN coalesce(list_position(same, false), 0) > 0 THEN list_position(same, false) - 1 ELSE len(same) END AS anneal FROM reached),
spans AS (SELECT *, (CASE WHEN strand = 1 THEN pos + 12 - anneal ELSE pos END) % n AS start, (CASE WHEN strand = 1 THEN pos + 11 ELSE pos + anneal - 1 END) % n AS stop
  FROM annealed WHERE anneal >= 15),
best AS (SELECT *, CASE WHEN strand = 1 THEN stop ELSE start END AS three_prime FROM spans
  QUALIFY row_number() OVER (PARTITION BY file, name, strand, CASE WHEN strand = 1 THEN stop ELSE start END ORDER BY anneal DESC, ord) = 1),
k AS (SELECT file || '|' || name || '|' || strand || '|' || three_prime AS key,
  CASE WHEN strand = 1 THEN substr(q, (length(q) - anneal + 1)::INT) ELSE substr(q, 1, anneal::INT) END AS s FROM best), {tm_sql("k")},
primer_hits AS (SELECT file, name, ord, strand, anneal::BIGINT AS anneal, (length(q) - anneal)::BIGINT AS overhang, start::BIGINT AS start, stop::BIGINT AS "end",
  three_prime::BIGINT AS three_prime, stop < start AS wraps, floor(tm * 10 + 0.5) / 10 AS tm FROM best JOIN tms ON key = file || '|' || name || '|' || strand || '|' || three_prime)"""


def primer_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.primer_search(corpus(spark, sf_dir).select("file", "sequence", "circular"), _primers(spark, sf_dir))


def primer_search_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.in_scope(primer_search(spark, sf_dir).where("overhang = 0"), 400, 200)


def primer_search_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.capped(primer_search(spark, sf_dir), 2).select("file", "name", "strand", "three_prime", "place")


def in_silico_pcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.in_silico_pcr(primer_search(spark, sf_dir), 3000)


W = f"WITH {CORPUS_SQL}, {PRIMERS_SQL}"
SEARCH_SQL = f"{W} SELECT * FROM primer_hits"
SCOPED_SQL = f"{W} SELECT * FROM primer_hits WHERE overhang = 0 AND (three_prime >= 400 OR three_prime <= 200)"
CAPPED_SQL = f"""{W} SELECT file, name, strand, three_prime, row_number() OVER (PARTITION BY file ORDER BY three_prime, overhang, name, strand DESC) AS place
FROM (SELECT * FROM primer_hits QUALIFY row_number() OVER (PARTITION BY file ORDER BY ord, strand DESC, three_prime) <= 2)"""
PCR_SQL = f"""{W} SELECT f.file, f.name AS forward, r.name AS reverse, f.start AS product_start, r."end" AS product_end, r."end" - f.start + 1 AS length
FROM primer_hits f JOIN primer_hits r ON f.file = r.file AND f.strand = 1 AND r.strand = -1 AND f."end" < r.start AND r."end" - f.start < 3000"""

QUERIES = {
    "primer_search": (primer_search, SEARCH_SQL),
    "primer_search_scoped": (primer_search_scoped, SCOPED_SQL),
    "primer_search_capped": (primer_search_capped, CAPPED_SQL),
    "in_silico_pcr": (in_silico_pcr, PCR_SQL),
}
