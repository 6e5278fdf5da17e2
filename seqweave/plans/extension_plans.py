"""Queries of the aligner, the scans by published definitions, and the SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.register import register
from ..operators import aligner, scans
from ..sources import formats as M
from .alignment_plans import _reads
from .search_plans import FRAMES_SQL, REV
from .workloads import CORPUS_SQL, QUERIES_SQL, corpus, queries, table


def align_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = aligner.align_reads(_reads(spark, sf_dir))
    return a.select("doc_id", "strand", "rotation", "crosses_origin", "substitutions", "gaps", "compared", F.round("identity", 6).alias("identity"))


def orf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.orf_scan(corpus(spark, sf_dir), 5)


ORF_SQL = f"""
WITH {CORPUS_SQL}, {FRAMES_SQL},
parts AS (SELECT file, bases, strand, frame, o, generate_subscripts(string_split(protein, '*'), 1) AS i, unnest(string_split(protein, '*')) AS part, len(string_split(protein, '*')) AS n FROM frames),
placed AS (SELECT *, coalesce(sum(length(part) + 1) OVER (PARTITION BY file, frame ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM parts),
orfs AS (SELECT *, pos + strpos(part, 'M') - 1 AS first, length(part) - strpos(part, 'M') + 1 AS residues FROM placed WHERE i < n AND strpos(part, 'M') > 0)
SELECT file, frame::INT AS frame, (CASE WHEN strand > 0 THEN o + 3 * first ELSE bases - 1 - (o + 3 * (first + residues + 1) - 1) END)::BIGINT AS start,
  (CASE WHEN strand > 0 THEN o + 3 * (first + residues + 1) - 1 ELSE bases - 1 - (o + 3 * first) END)::BIGINT AS "end", residues::BIGINT AS residues FROM orfs WHERE residues >= 5"""


def cut_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.cut_sites(corpus(spark, sf_dir))


_SITES = ", ".join(f"('{k}', '{v}')" for k, v in sorted(scans.ENZYMES.items()))
_PATTERN = "replace({0}, 'N', '.')"
CUT_SQL = f"""
WITH {CORPUS_SQL}, e AS (SELECT * FROM (VALUES {_SITES}) t(enzyme, site)),
p AS (SELECT enzyme, 1 AS strand, {_PATTERN.format("site")} AS pat, length(site) AS k FROM e UNION ALL
  SELECT enzyme, -1, {_PATTERN.format(REV.format("site"))}, length(site) FROM e WHERE {REV.format("site")} <> site OR contains(site, 'N')),
t AS (SELECT file, length(sequence) AS n, sequence || CASE WHEN circular THEN substr(sequence, 1, 5) ELSE '' END AS text FROM corpus),
w AS (SELECT file, text, unnest(range(0, n)) AS pos FROM t)
SELECT DISTINCT file, enzyme, strand, pos AS start FROM w JOIN p ON regexp_full_match(substr(text, (pos + 1)::INT, k), pat)"""


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions from SQL, the table function too: a query's distinct 8-mers."""
    register(spark)
    queries(spark, sf_dir).createOrReplaceTempView("seqweave_queries")
    return spark.sql("""
        SELECT query_id, rev_comp(sequence) AS rc, round(gc_fraction(sequence), 9) AS gc, guess_molecule(sequence) AS molecule, count(DISTINCT k.kmer) AS kmers
        FROM seqweave_queries, LATERAL kmers(sequence, 8) k GROUP BY ALL""")


FUNCTIONS_SQL = f"""
WITH {QUERIES_SQL}, k AS (SELECT query_id, sequence, unnest(range(0, greatest(0, length(sequence) - 7))) AS i FROM queries)
SELECT query_id, {REV.format("any_value(sequence)")} AS rc, round(length(regexp_replace(any_value(sequence), '[^GC]', '', 'g')) / length(any_value(sequence)), 9) AS gc, 'dna' AS molecule,
  count(DISTINCT substr(sequence, (i + 1)::INT, 8)) AS kmers FROM k GROUP BY query_id"""


def sql_table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as lines of FASTA, a document a path, read back by a table function, with the frames that each text has."""
    register(spark)
    rows = corpus(spark, sf_dir).select("file", F.coalesce("sequence", F.lit("")).alias("sequence"))
    lines = F.concat(F.array(F.concat(F.lit("> "), "file")), F.regexp_extract_all("sequence", F.lit(".{1,60}"), F.lit(0)))
    rows.select(F.col("file").alias("path"), F.posexplode(lines).alias("line_no", "line")).createOrReplaceTempView("seqweave_lines")
    return spark.sql("""
        SELECT r.path, r.record, r.name, length(r.sequence) AS n, f.strand, f.frame, f.protein
        FROM fasta_records(TABLE(seqweave_lines)) r, LATERAL six_frames(r.sequence) f""")


TABLE_FUNCTIONS_SQL = f"""WITH {CORPUS_SQL}, {FRAMES_SQL}
SELECT file AS path, 0 AS record, file AS name, bases AS n, strand, frame, protein FROM frames"""


def safe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row ids of alignments of a hundred documents, named by language, in order of id."""
    d = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 100).alias("alignment")).agg(F.array_sort(F.collect_list(F.struct("doc_id", F.concat_ws(" ", "lang", F.lit("(x)")).alias("name")))).alias("rows"))

    def run(rows: list) -> list[dict]:
        return [{"doc_id": r["doc_id"], "id": i} for r, i in zip(rows, M.safe_ids([r["name"] for r in rows]), strict=True)]

    return M.parsed(d, run, ["rows"], "doc_id long, id string")


SAFE_SQL = """SELECT doc_id // 100 AS alignment, doc_id, lang || '__x_' || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS id
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id // 100, lang ORDER BY doc_id) AS n FROM documents)"""

QUERIES = {
    "align_reads": (align_reads, None),
    "orf_scan": (orf_scan, ORF_SQL),
    "cut_sites": (cut_sites, CUT_SQL),
    "sql_functions": (sql_functions, FUNCTIONS_SQL),
    "sql_table_functions": (sql_table_functions, TABLE_FUNCTIONS_SQL),
    "safe_ids": (safe_ids, SAFE_SQL),
}
