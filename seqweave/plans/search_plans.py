"""Queries of the search operators, with DuckDB SQL that computes the same by another way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import search
from .workloads import CORPUS_SQL, QUERIES_SQL, corpus, queries, table

REV = "reverse(translate(regexp_replace(upper({0}), '[^ACGTUNRYSWKMBVDH]', 'N', 'g'), 'ACGTUNRYSWKMBVDH', 'TGCAANYRSWMKVBHD'))"
STRANDS_SQL = f"""probes AS (
  SELECT query_id, 1 AS strand, sequence AS probe FROM queries
  UNION ALL SELECT query_id, -1, {REV.format("sequence")} FROM queries WHERE {REV.format("sequence")} <> sequence)"""
CODE = S.GENETIC_CODE


def aa(codon: str) -> str:
    i = " + ".join(f"{16 // 4**k} * (strpos('TCAG', substr({codon}, {k + 1}, 1)) - 1)" for k in range(3))
    return f"substr('{CODE}', ({i} + 1)::INT, 1)"


FRAMES_SQL = f"""reads AS (
  SELECT file, name, length(sequence) AS bases, 1 AS strand, sequence AS read FROM corpus
  UNION ALL SELECT file, name, length(sequence), -1, {REV.format("sequence")} FROM corpus),
frames AS (
  SELECT file, name, bases, strand, strand * (o + 1) AS frame, o,
         array_to_string(list_transform(range(0, greatest(0, (bases - o) // 3)), lambda i: {aa("substr(read, (o + 3 * i + 1)::INT, 3)")}), '') AS protein
  FROM reads, (SELECT unnest([0, 1, 2]) AS o))"""


def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact_search(corpus(spark, sf_dir), queries(spark, sf_dir))


EXACT_SQL = f"""
WITH {CORPUS_SQL}, {QUERIES_SQL}, {STRANDS_SQL},
places AS (
  SELECT c.file, c.name, c.sequence, p.*, unnest(range(0, greatest(0, length(c.sequence) - length(p.probe) + 1))) AS pos
  FROM corpus c JOIN probes p ON contains(c.sequence, p.probe) AND p.probe <> ''),
hits AS (
  SELECT query_id, file, name, pos::BIGINT AS start, (pos + length(probe) - 1)::BIGINT AS "end", strand, length(probe)::BIGINT AS length,
         1.0::DOUBLE AS identity, length(probe)::BIGINT AS score, NULL::INT AS frame
  FROM places WHERE substr(sequence, (pos + 1)::INT, length(probe)) = probe)
SELECT * FROM hits
"""


def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuzzy_search(corpus(spark, sf_dir), queries(spark, sf_dir))


def _side(sign: int, first: str, steps: str) -> str:
    """Steps away from the seed in one direction: running score, running best, stop after the first drop of over 8."""
    return f"""
  SELECT file, query_id, strand, t, coalesce(max(gain), 0) AS gain, coalesce(min(step) FILTER (gain = best), 0) AS steps FROM (
    SELECT *, max(gain) OVER (PARTITION BY file, query_id, strand, t - q) AS best FROM (
      SELECT *, sum(CASE WHEN greatest(top, 0) - gain > 8 THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS stops FROM (
        SELECT *, max(gain) OVER (w ROWS UNBOUNDED PRECEDING) AS top FROM (
          SELECT *, sum(CASE WHEN substr(sequence, ({first.format("t")} + 1)::INT, 1) = substr(probe, ({first.format("q")} + 1)::INT, 1) THEN 1 ELSE -1 END)
                      OVER (w ROWS UNBOUNDED PRECEDING) AS gain
          FROM (SELECT *, unnest(range(1, greatest(1, ({steps}) + 1))) AS step FROM seeds) WINDOW w AS (PARTITION BY file, query_id, strand, t - q ORDER BY step))
        WINDOW w AS (PARTITION BY file, query_id, strand, t - q ORDER BY step))
      WINDOW w AS (PARTITION BY file, query_id, strand, t - q ORDER BY step)) WHERE stops = 0)
  WHERE gain > 0 GROUP BY file, query_id, strand, t, q"""


def fuzzy_sql(targets: str, probes: str, k: str, tail: str, min_identity: float = 0.8) -> str:
    """targets: file, name, sequence; probes: query_id, strand, probe, k."""
    return f"""
WITH {targets}, {probes},
tk AS (SELECT t.*, k, unnest(range(0, greatest(0, length(sequence) - k + 1))) AS t FROM targets t, (SELECT DISTINCT k FROM searched)),
qk AS (SELECT query_id, strand, k, kmer, min(q) AS q FROM (
    SELECT query_id, strand, k, q, substr(probe, (q + 1)::INT, k) AS kmer
    FROM (SELECT *, unnest(range(0, greatest(0, length(probe) - k + 1))) AS q FROM searched)) GROUP BY ALL),
first AS (
  SELECT file, name, query_id, strand, qk.k, min(t) AS t, arg_min(q, t) AS q
  FROM tk JOIN qk ON tk.k = qk.k AND substr(tk.sequence, (tk.t + 1)::INT, tk.k) = qk.kmer GROUP BY file, name, query_id, strand, qk.k, t - q),
seeds AS (SELECT f.*, sequence, probe FROM first f JOIN targets USING (file, name) JOIN searched USING (query_id, strand)),
lefts AS ({_side(-1, "({} - step)", "least(t, q)")}),
rights AS ({_side(1, "({} + k - 1 + step)", "least(length(sequence) - t - k, length(probe) - q - k)")}),
matched AS (
  SELECT s.*, s.t - coalesce(l.steps, 0) AS pos, coalesce(l.steps, 0) + k + coalesce(r.steps, 0) AS length, coalesce(l.gain, 0) + k + coalesce(r.gain, 0) AS score
  FROM seeds s LEFT JOIN lefts l USING (file, query_id, strand, t) LEFT JOIN rights r USING (file, query_id, strand, t)
  ),
hits AS (
  SELECT *, ((length + score) / 2) / length AS identity FROM matched
  WHERE ((length + score) / 2) / length >= {min_identity} AND length >= length(probe) * 0.5)
{tail}"""


FUZZY_TARGETS = f"{CORPUS_SQL}, targets AS (SELECT file, name, sequence FROM corpus)"
FUZZY_PROBES = f"{QUERIES_SQL}, {STRANDS_SQL}, searched AS (SELECT *, 11 AS k FROM probes)"
HITS = """SELECT query_id, file, name, pos::BIGINT AS start, (pos + length - 1)::BIGINT AS "end", strand, length::BIGINT AS length, identity,
       score::BIGINT AS score, NULL::INT AS frame FROM hits"""
FUZZY_SQL = fuzzy_sql(FUZZY_TARGETS, FUZZY_PROBES, "11", HITS)


def ranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(fuzzy_search(spark, sf_dir), 20)


RANKED_SQL = fuzzy_sql(FUZZY_TARGETS, FUZZY_PROBES, "11", f"""SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, identity DESC, start, file, strand DESC, frame NULLS FIRST, "end") AS rank
  FROM ({HITS})) WHERE rank <= 20""")  # fmt: skip


def translate_six_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.six_frames(corpus(spark, sf_dir).select("file", "sequence")).select("file", "frame", "protein")


SIX_SQL = f"WITH {CORPUS_SQL}, {FRAMES_SQL} SELECT file, frame::INT AS frame, protein FROM frames"


def _peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's first frame."""
    return queries(spark, sf_dir).select("query_id", S.translate_frame("sequence", 0).alias("sequence"))


PEPTIDES_SQL = f"""{QUERIES_SQL}, peptides AS (
  SELECT query_id, array_to_string(list_transform(range(0, length(sequence) // 3), lambda i: {aa("substr(sequence, (3 * i + 1)::INT, 3)")}), '') AS sequence
  FROM queries)"""
FRAME_COORDS = """(CASE WHEN strand > 0 THEN o + 3 * pos ELSE bases - 1 - (o + 3 * (pos + {n}) - 1) END)::BIGINT AS start,
       (CASE WHEN strand > 0 THEN o + 3 * (pos + {n}) - 1 ELSE bases - 1 - (o + 3 * pos) END)::BIGINT AS "end" """


def protein_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.protein_exact_search(corpus(spark, sf_dir), _peptides(spark, sf_dir))


PROTEIN_SQL = f"""
WITH {CORPUS_SQL}, {PEPTIDES_SQL}, {FRAMES_SQL},
places AS (
  SELECT f.*, p.query_id, p.sequence AS probe, unnest(range(0, greatest(0, length(protein) - length(p.sequence) + 1))) AS pos
  FROM frames f JOIN peptides p ON p.sequence <> '' AND contains(f.protein, p.sequence))
SELECT query_id, file, name, {FRAME_COORDS.format(n="length(probe)")}, strand, length(probe)::BIGINT AS length, 1.0::DOUBLE AS identity,
       length(probe)::BIGINT AS score, frame::INT AS frame
FROM places WHERE substr(protein, (pos + 1)::INT, length(probe)) = probe
"""


def protein_fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.protein_fuzzy_search(corpus(spark, sf_dir), _peptides(spark, sf_dir), min_identity=0.7)


PROTEIN_FUZZY_SQL = fuzzy_sql(
    f"""{CORPUS_SQL}, {FRAMES_SQL}, targets AS (SELECT file || '|' || frame AS file, name, protein AS sequence FROM frames)""",
    f"""{QUERIES_SQL}, whole AS (SELECT query_id, array_to_string(list_transform(range(0, length(sequence) // 3),
        lambda i: {aa("substr(sequence, (3 * i + 1)::INT, 3)")}), '') AS probe FROM queries),
      searched AS (SELECT query_id, 1 AS strand, probe, least(11, greatest(3, length(probe) // 2))::INT AS k FROM whole)""",
    "", f"""SELECT query_id, split_part(h.file, '|', 1) AS file, h.name, {FRAME_COORDS.format(n="length")}, f.strand, length::BIGINT AS length, identity,
       score::BIGINT AS score, frame::INT AS frame FROM (SELECT * EXCLUDE (strand, name), name AS name FROM hits) h
       JOIN frames f ON h.file = f.file || '|' || f.frame""", 0.7,
)


def find_with_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_with_mismatches(corpus(spark, sf_dir).select("file", "sequence", "circular"), queries(spark, sf_dir), 2)


MISMATCH_SQL = f"""
WITH {CORPUS_SQL}, {QUERIES_SQL}, {STRANDS_SQL},
doubled AS (SELECT file, length(sequence) AS n, CASE WHEN circular THEN sequence || sequence ELSE sequence END AS text FROM corpus),
lengths AS (SELECT DISTINCT length(probe) AS m FROM probes WHERE length(probe) > 2),
windows AS (
  SELECT file, n, m, pos, substr(text, (pos + 1)::INT, m) AS w
  FROM (SELECT file, n, text, m, unnest(range(0, greatest(0, length(text) - m + 1))) AS pos FROM doubled, lengths))
SELECT DISTINCT query_id, file, strand, (pos % n)::BIGINT AS start, ((pos + m - 1) % n)::BIGINT AS "end"
FROM windows JOIN probes ON length(probe) = m AND hamming(w, probe) <= 2
"""


def sorted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header-click sort, kept as a place: numeric column ascending, then natural name order, descending."""
    hits = exact_search(spark, sf_dir).withColumn("natural", S.natural_key("file"))
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.col("start").asc_nulls_first(), F.desc("natural"), F.desc("strand"))
    return hits.select("query_id", "file", "start", "strand", F.row_number().over(w).cast("long").alias("place"))


SORTED_SQL = f"""
SELECT query_id, file, start, strand, row_number() OVER (PARTITION BY query_id
  ORDER BY start NULLS FIRST, regexp_extract(file, '\\d+')::BIGINT DESC, strand DESC) AS place FROM ({EXACT_SQL})"""


def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    names = table(spark, sf_dir, "documents").select(F.concat_ws(" ", "source", F.concat(F.lit("Read"), F.col("doc_id").cast("string"))).alias("name"))
    w = Window.partitionBy(F.split("name", " ")[0]).orderBy(S.natural_key("name"))
    return names.select("name", F.row_number().over(w).cast("long").alias("place"))


NATURAL_SQL = """
SELECT name, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place
FROM (SELECT source, doc_id, source || ' Read' || doc_id AS name FROM documents)"""


QUERIES = {
    "exact_search": (exact_search, EXACT_SQL),
    "fuzzy_search": (fuzzy_search, FUZZY_SQL),
    "ranked_topk": (ranked_topk, RANKED_SQL),
    "translate_six_frames": (translate_six_frames, SIX_SQL),
    "protein_exact_search": (protein_exact_search, PROTEIN_SQL),
    "protein_fuzzy_search": (protein_fuzzy_search, PROTEIN_FUZZY_SQL),
    "find_with_mismatches": (find_with_mismatches, MISMATCH_SQL),
    "sorted_hits": (sorted_hits, SORTED_SQL),
    "natural_sort": (natural_sort, NATURAL_SQL),
}
