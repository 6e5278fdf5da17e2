"""Queries of ambiguous searches and of overlapping ranges, and SQL by expansion: a two-letter code fits as often as its letters do, taken one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import translate_frame
from ..operators.ambiguous import find_ambiguous as find
from ..operators.ranges import overlapping
from ..shared import scratch
from .search_plans import REV, aa
from .workloads import CORPUS_SQL, QUERIES_SQL, corpus, queries

MOST = 1
#: Places of the circle on which ranges lie.
CIRCLE = 5000


def _coded(s, f):
    return F.array_join(F.transform(F.split(s, ""), f), "")


def find_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark bases with unknown ones and purines among them, with a mismatch."""
    coded = _coded(F.col("sequence"), lambda x, i: F.when(i % 9 == 4, "N").when((i % 9 == 8) & x.isin("A", "G"), "R").otherwise(x))
    q = queries(spark, sf_dir).select("query_id", coded.alias("sequence"))
    return find(corpus(spark, sf_dir).select("file", "sequence", "circular"), q, MOST)


# Misses at R are #R less those that fit A and those that fit G; N fits nothing as a letter, and all as a code.
AMBIGUOUS_SQL = f"""WITH {CORPUS_SQL}, {QUERIES_SQL},
coded AS (SELECT query_id, array_to_string(list_transform(string_split(sequence, ''), lambda x, i: CASE WHEN (i - 1) % 9 = 4 THEN 'N' WHEN (i - 1) % 9 = 8 AND x IN ('A', 'G') THEN 'R' ELSE x END), '') AS s
  FROM queries WHERE sequence <> ''),
back AS (SELECT query_id, s, translate(reverse(s), 'ACGTRN', 'TGCAYN') AS r FROM coded),
probes AS (SELECT query_id, 1 AS strand, replace(s, 'R', 'A') AS one, replace(s, 'R', 'G') AS two, replace(s, 'R', 'N') AS three, length(s) - length(replace(s, 'N', '')) AS free FROM back
  UNION ALL SELECT query_id, -1, replace(r, 'Y', 'C'), replace(r, 'Y', 'T'), replace(r, 'Y', 'N'), length(r) - length(replace(r, 'N', '')) FROM back WHERE r <> s),
doubled AS (SELECT file, length(sequence) AS n, CASE WHEN circular THEN sequence || sequence ELSE sequence END AS text FROM corpus),
lengths AS (SELECT DISTINCT length(one) AS m FROM probes),
windows AS (SELECT file, n, m, pos, substr(text, (pos + 1)::INT, m) AS w FROM (SELECT file, n, text, m, unnest(range(0, greatest(0, length(text) - m + 1))) AS pos FROM doubled, lengths))
SELECT DISTINCT query_id, file, strand::INTEGER AS strand, (pos % n)::BIGINT AS start, ((pos + m - 1) % n)::BIGINT AS "end"
FROM windows JOIN probes ON length(one) = m AND hamming(w, one) + hamming(w, two) - hamming(w, three) - free <= {MOST}"""


def find_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's peptides with unknown residues among them, in all frames, with a mismatch."""
    q = queries(spark, sf_dir).select("query_id", translate_frame("sequence", 0).alias("sequence"))
    q = q.select("query_id", _coded(F.col("sequence"), lambda x, i: F.when(i % 5 == 2, "X").otherwise(x)).alias("sequence"))
    return find(corpus(spark, sf_dir).select("file", "sequence", "circular"), q, MOST, protein=True)


RESIDUES_SQL = f"""WITH {CORPUS_SQL}, {QUERIES_SQL},
peptides AS (SELECT query_id, list_transform(range(0, length(sequence) // 3), lambda i: CASE WHEN i % 5 = 2 THEN 'X' ELSE {aa("substr(sequence, (3 * i + 1)::INT, 3)")} END) AS p FROM queries),
probes AS (SELECT query_id, array_to_string(p, '') AS s, len(list_filter(p, lambda x: x = 'X')) AS free FROM peptides WHERE len(p) > 0),
doubled AS (SELECT file, length(sequence) AS n, CASE WHEN circular THEN sequence || sequence ELSE sequence END AS text FROM corpus),
subjects AS (SELECT file, n, length(text) AS total, 1 AS strand, text FROM doubled UNION ALL SELECT file, n, length(text), -1, {REV.format("text")} FROM doubled),
frames AS (SELECT file, n, total, strand, o, array_to_string(list_transform(range(0, greatest(0, (total - o) // 3)), lambda i: {aa("substr(text, (o + 3 * i + 1)::INT, 3)")}), '') AS f
  FROM subjects, (SELECT unnest([0, 1, 2]) AS o)),
lengths AS (SELECT DISTINCT length(s) AS m FROM probes),
windows AS (SELECT file, n, total, strand, o, m, pos, substr(f, (pos + 1)::INT, m) AS w FROM (SELECT *, unnest(range(0, greatest(0, length(f) - m + 1))) AS pos FROM frames, lengths)),
hits AS (SELECT query_id, file, strand, n, total, 3 * pos + o AS a, 3 * (pos + m) + o - 1 AS b FROM windows JOIN probes ON length(s) = m AND hamming(w, s) - free <= {MOST})
SELECT DISTINCT query_id, file, strand::INTEGER AS strand, ((CASE WHEN strand > 0 THEN a ELSE total - 1 - b END) % n)::BIGINT AS start,
  ((CASE WHEN strand > 0 THEN b ELSE total - 1 - a END) % n)::BIGINT AS "end" FROM hits"""

def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of each document's source, a circle of 5,000 places: some go over its origin, empty documents have none."""
    n, d = F.length("sequence"), F.col("doc_id")
    start = F.pmod(d * 37, F.lit(CIRCLE))
    end = F.when(n > 0, F.pmod(start + F.least(n, F.lit(4000)) - 1, F.lit(CIRCLE)))
    return corpus(spark, sf_dir).select("doc_id", "name", start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(CIRCLE).cast("long").alias("length"))


def feature_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of documents of one source, of every other seven documents against those between, that overlap."""
    # Both sides are read several times: the texts' lengths are taken once.
    r, path = _ranges(spark, sf_dir), scratch(spark, "ranges")
    r.write.mode("overwrite").parquet(path)
    r = spark.read.schema(r.schema).parquet(path)
    pairs = overlapping(r.where("doc_id div 7 % 2 = 0"), r.where("doc_id div 7 % 2 = 1"), ["name"], "length", CIRCLE.bit_length())
    return pairs.select("name", "l_doc_id", "r_doc_id")


RANGES_SQL = f"""{CORPUS_SQL}, ranges AS (SELECT doc_id, name, (doc_id * 37) % 5000 AS a,
  CASE WHEN sequence <> '' THEN ((doc_id * 37) % 5000 + least(length(sequence), 4000) - 1) % 5000 END AS b FROM corpus)"""
OVERLAP_SQL = f"""WITH {RANGES_SQL}
SELECT l.name, l.doc_id AS l_doc_id, r.doc_id AS r_doc_id FROM ranges l JOIN ranges r ON l.name = r.name AND l.doc_id // 7 % 2 = 0 AND r.doc_id // 7 % 2 = 1 AND l.b IS NOT NULL AND r.b IS NOT NULL
WHERE ((CASE WHEN r.a <= r.b THEN l.a BETWEEN r.a AND r.b ELSE l.a >= r.a OR l.a <= r.b END) OR (CASE WHEN l.a <= l.b THEN r.a BETWEEN l.a AND l.b ELSE r.a >= l.a OR r.a <= l.b END))"""


QUERIES = {"find_ambiguous": (find_ambiguous, AMBIGUOUS_SQL), "find_residues": (find_residues, RESIDUES_SQL), "feature_overlap": (feature_overlap, OVERLAP_SQL)}
