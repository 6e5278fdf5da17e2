"""Queries of the file formats: files are rendered from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment as A
from ..sources import formats as M
from .alignment_plans import PAIRS_SQL, _pairs
from .workloads import CORPUS_SQL, QUERIES_SQL, corpus, queries, table


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, text: a flat file of each document, with a second record that must not be read by the base scan."""
    c = corpus(spark, sf_dir)
    lines = F.array_join(F.transform(F.regexp_extract_all(F.lower("sequence"), F.lit(".{1,60}"), F.lit(0)), lambda x, i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), x)), "\n")
    feature = F.concat(F.lit("     CDS             complement(5..20)\n                     /label=\""), F.col("name"), F.lit("\"\n     gene            join(3..8,10..13)\n"))
    head = F.concat(F.lit("LOCUS       "), F.col("file"), F.lit(" x bp DNA "), F.when(F.col("circular"), "circular").otherwise("linear"), F.lit("\nFEATURES             Location/Qualifiers\n"), feature)
    return c.select("file", "name", F.concat(head, F.lit("ORIGIN      \n"), lines, F.lit("\n//\nLOCUS       other\nORIGIN\n        1 acgtacgt\n//\n")).alias("text"))


def scan_origin_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(spark, sf_dir).select("file", M.origin_bases("text").alias("bases"))


ORIGIN_SQL = f"WITH {CORPUS_SQL} SELECT file, sequence AS bases FROM corpus"


def genbank_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(text: str) -> list[dict]:
        return [{"record": r["name"], "circular": r["circular"], "bases": len(r["sequence"]), "features": ";".join(f"{f['type']} {f['name']} {f['start']}-{f['end']} {f['strand']} {len(f['locations'])}" for f in r["features"])} for r in M.parse_genbank(text)]

    return M.parsed(_flat(spark, sf_dir).select("file", "text"), run, ["text"], "record string, circular boolean, bases long, features string")


GENBANK_SQL = f"""WITH {CORPUS_SQL} SELECT file, file AS record, circular, length(sequence) AS bases, 'CDS ' || name || ' 4-19 -1 0;gene gene 2-12 1 2' AS features FROM corpus
UNION ALL SELECT file, 'other', false, 8, '' FROM corpus"""


def genbank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested, remote, open and between-base locations, a primer and a location over two lines, in a flat file of each document."""
    c, d = corpus(spark, sf_dir), F.col("doc_id").cast("string")
    plus = lambda k: (F.col("doc_id") + k).cast("string")
    entry = lambda kind, *where: F.concat(F.lit(f"     {kind:<16}"), *(F.lit(x) if isinstance(x, str) else x for x in where), F.lit("\n"))
    table_ = [
        entry("CDS", "join(complement(50..60),complement(10..20))"), entry("gene", "order(1..5,complement(8..9))"), entry("mRNA", "join(J00194.1:100..202,1..", plus(3), ")"),
        entry("site", "123^124"), entry("exon", "complement(join(<3..8,\n                     10..>13,", d, "))"), entry("primer_bind", "complement(4..", plus(9), ")"), entry("variation", plus(1)),
        entry("unsure", "join(1..5"),
    ]
    text = F.concat(F.lit("LOCUS       "), "file", F.lit(" 8 bp DNA linear\nFEATURES             Location/Qualifiers\n"), *table_, F.lit("ORIGIN\n        1 acgtacgt\n//\n"))
    return M.genbank_features(c.select("file", text.alias("text")))


FEATURES_SQL = f"""WITH {CORPUS_SQL}
SELECT file, file AS record, p AS primer, f AS feature, k AS type, k AS name, i AS part, (CASE WHEN a < 0 THEN doc_id - a - 100 ELSE a END)::BIGINT AS start,
  (CASE WHEN b < 0 THEN doc_id - b - 100 ELSE b END)::BIGINT AS "end", s::INTEGER AS strand, r AS remote, w AS between
FROM corpus, (VALUES (false, 0::BIGINT, 'CDS', 0::BIGINT, 49, 59, -1, NULL, false), (false, 0, 'CDS', 1, 9, 19, -1, NULL, false), (false, 1, 'gene', 0, 0, 4, 1, NULL, false),
  (false, 1, 'gene', 1, 7, 8, -1, NULL, false), (false, 2, 'mRNA', 0, 99, 201, 1, 'J00194.1', false), (false, 2, 'mRNA', 1, 0, -102, 1, NULL, false),
  (false, 3, 'site', 0, 122, 123, 1, NULL, true), (false, 4, 'exon', 0, -99, -99, -1, NULL, false), (false, 4, 'exon', 1, 9, 12, -1, NULL, false),
  (false, 4, 'exon', 2, 2, 7, -1, NULL, false), (true, 0, 'primer_bind', 0, 3, -108, -1, NULL, false), (false, 5, 'variation', 0, -100, -100, 1, NULL, false)) t(p, f, k, i, a, b, s, r, w)"""


def track_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' letters, or only their bases, in files of all text formats, read with and without codes of several bases as bases."""
    d = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("fa", "fasta", "faa", "dna"))), (d % 4 + 1).cast("int"))
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    body = F.when(d % 3 == 0, F.regexp_replace(letters, "[^ACGTNRYacgtnry]", "")).otherwise(letters)
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("in/"), d.cast("string"), F.lit("."), kind).alias("path"), M.to_fasta(F.lit("x"), body).cast("binary").alias("content"))
    read = [M.tracks(files, loose=x).select("file", F.lit(x).alias("loose"), "molecule", F.length("sequence").cast("long").alias("letters")) for x in (True, False)]
    return read[0].unionByName(read[1])


MOLECULES_SQL = """WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') AS x FROM documents),
s AS (SELECT 'in/' || doc_id || '.' || ['fa', 'fasta', 'faa', 'dna'][doc_id % 4 + 1] AS file, doc_id % 4 = 3 AS fixed,
  upper(CASE WHEN doc_id % 3 = 0 THEN regexp_replace(x, '[^ACGTNRYacgtnry]', '', 'g') ELSE x END) AS s FROM d)
SELECT file, loose, CASE WHEN fixed OR length(regexp_replace(s, CASE WHEN loose THEN '[^ACGTURYSWKMBDHVN]' ELSE '[^ACGTUN]' END, '', 'g')) / length(s) > 0.9 THEN 'dna' ELSE 'protein' END AS molecule,
  length(s)::BIGINT AS letters FROM s, (VALUES (true), (false)) l(loose) WHERE s <> ''"""


def parse_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A FASTA text a source, of its documents in two lines each."""
    c = corpus(spark, sf_dir)
    half = F.floor(F.length("sequence") / 2).cast("int")
    record = F.concat(F.lit(">"), "file", F.lit(" \n"), F.substr(F.col("sequence"), F.lit(1), half), F.lit("\n "), F.substr(F.col("sequence"), half + 1), F.lit("\n"))
    return M.fasta_records(c.select(F.col("name").alias("source"), F.concat(F.lit("ignored\n"), record, F.lit(">empty\n")).alias("text"))).select("source", "record", "name", "sequence")


FASTA_SQL = f"WITH {CORPUS_SQL} SELECT name AS source, 0::BIGINT AS record, file AS name, sequence FROM corpus UNION ALL SELECT name, 1, 'empty', '' FROM corpus"


def to_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("file", M.to_fasta("file", "sequence").alias("text"))


TO_FASTA_SQL = f"WITH {CORPUS_SQL} SELECT file, '>' || file || chr(10) || sequence || chr(10) AS text FROM corpus"


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return A._map(p, lambda name, ref, read, wraps: (M.write_stockholm({"name": "ref one", "row": ref, "circular": wraps}, [{"name": name, "row": read, "strand": -1, "rotation": 3, "covered": "1-5"}, {"name": name, "row": read}]),), ["name", "reference_row", "read_row", "wraps"], "text string").select("doc_id", "text")


def stockholm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment rows and tags as written, line by line."""
    lines = _saved(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where(F.col("line").startswith("#=GS") | ~F.col("line").rlike("^(#|//|$)")).select("doc_id", F.col("n").cast("long").alias("n"), "line")


_ROWS = f"""rows AS (SELECT doc_id, any_value(wraps) AS wraps, any_value(CASE WHEN doc_id % 5 = 0 THEN '_R_' ELSE '' END || file) AS name, string_agg(r, '' ORDER BY i) AS r, string_agg(q, '' ORDER BY i) AS q,
  count(*) FILTER (r <> '-') AS bases FROM cols GROUP BY doc_id)"""
STOCKHOLM_SQL = f"""WITH {PAIRS_SQL}, {_ROWS}
SELECT doc_id, n::BIGINT AS n, line FROM (SELECT doc_id, unnest([
  {{'n': 7, 'line': '#=GS ref_one DE ref one'}}, {{'n': 8, 'line': '#=GS ref_one SW role=reference circular=' || wraps::INT || ' length=' || bases}},
  {{'n': 10, 'line': '#=GS ' || name || ' DE ' || name}}, {{'n': 11, 'line': '#=GS ' || name || ' SW role=read strand=-1 rotation=3 folded=0 anchored=1'}}, {{'n': 12, 'line': '#=GS ' || name || ' COV 1-5'}},
  {{'n': 14, 'line': '#=GS ' || name || '_2 DE ' || name}}, {{'n': 15, 'line': '#=GS ' || name || '_2 SW role=read strand=1 rotation=0 folded=0 anchored=1'}},
  {{'n': 17, 'line': rpad('ref_one', greatest(7, length(name) + 2)::INT, ' ') || '  ' || r}}, {{'n': 18, 'line': rpad(name, greatest(7, length(name) + 2)::INT, ' ') || '  ' || q}},
  {{'n': 19, 'line': rpad(name || '_2', greatest(7, length(name) + 2)::INT, ' ') || '  ' || q}}], recursive := true) FROM rows)"""


def parse_stockholm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.parsed(_saved(spark, sf_dir), M.read_stockholm, ["text"], M.ALIGNMENT).select(
        "doc_id", "id", "name", "role", "row", "strand", "rotation", "circular", "folded", "anchored", "covered", "deleted"
    )


PARSED_SQL = f"""WITH {PAIRS_SQL}, {_ROWS}
SELECT doc_id, 'ref_one' AS id, 'ref one' AS name, 'reference' AS role, r AS row, 1 AS strand, 0::BIGINT AS rotation, wraps AS circular, false AS folded, true AS anchored, '' AS covered, '' AS deleted FROM rows
UNION ALL SELECT doc_id, name, name, 'read', q, -1, 3, true, false, true, '1-5', '' FROM rows UNION ALL SELECT doc_id, name || '_2', name, 'read', q, 1, 0, true, false, true, '', '' FROM rows"""


def sniff_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(" "), F.lit("\t"))).otherwise(F.col("text")).alias("text"))
    return d.select("doc_id", F.when(M.sniff_delimiter("text") == "\t", "tab").otherwise("comma").alias("delimiter"))


SNIFF_SQL = """WITH l AS (SELECT doc_id, string_split(CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', chr(9)) ELSE text END, chr(10))[1] AS l FROM documents)
SELECT doc_id, CASE WHEN length(l) - length(replace(l, chr(9), '')) > length(l) - length(replace(l, ',', '')) THEN 'tab' ELSE 'comma' END AS delimiter FROM l"""


def parse_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet a document, with quotes, doubled quotes and line ends in cells."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("﻿id,name\r\n"), F.col("doc_id").cast("string"), F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"\r\nlast,""\r\n')).alias("text"))

    def run(text: str) -> list[dict]:
        return [{"row": y, "column": x, "cell": v} for y, r in enumerate(M.parse_delimited(text)) for x, v in enumerate(r)]

    return M.parsed(d, run, ["text"], "row long, column long, cell string")


DELIMITED_SQL = """SELECT doc_id, unnest([{'row': 0, 'column': 0, 'cell': 'id'}, {'row': 0, 'column': 1, 'cell': 'name'}, {'row': 1, 'column': 0, 'cell': doc_id::VARCHAR}, {'row': 1, 'column': 1, 'cell': text},
  {'row': 2, 'column': 0, 'cell': 'last'}, {'row': 2, 'column': 1, 'cell': ''}], recursive := true) FROM documents"""


def xlsx_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook a benchmark passage, read back cell by cell."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    books = A._map(b, lambda i, t: (M.write_sheet([["Name", "", "Sequence & more"], [f"p{i}", "", t]], "Primers"),), ["item_id", "text"], "content binary").select("item_id", "content")

    def run(content: bytes) -> list[dict]:
        return [{"row": y, "column": x, "cell": v} for y, r in enumerate(M.read_sheet(content, "primers")) for x, v in enumerate(r)]

    return M.parsed(books, run, ["content"], "row long, column long, cell string")


XLSX_SQL = """SELECT item_id, unnest([{'row': 0, 'column': 0, 'cell': 'Name'}, {'row': 0, 'column': 1, 'cell': ''}, {'row': 0, 'column': 2, 'cell': 'Sequence & more'}, {'row': 1, 'column': 0, 'cell': 'p' || item_id},
  {'row': 1, 'column': 1, 'cell': ''}, {'row': 1, 'column': 2, 'cell': text}], recursive := true) FROM benchmark"""


def abif_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace file a benchmark passage's bases, written and read: calls, mean quality, window of the last base."""
    q = queries(spark, sf_dir).where(F.length("sequence") >= 5)

    def book(s: str) -> tuple:
        peaks = [5 + 6 * i for i in range(len(s))]
        return (M.write_abif(s, peaks, {c: [(i * k) % 500 for i in range(6 * len(s) + 9)] for k, c in enumerate("atgc", 1)}, [30 + i % 20 for i in range(len(s))], 2),)

    files = A._map(q, book, ["sequence"], "content binary").select("query_id", "content")

    def run(content: bytes) -> list[dict]:
        a = M.parse_abif(content)
        lo, hi = M.base_windows(a["peaks"], len(a["a"]))[-1]
        return [{"sequence": a["sequence"], "quality": sum(a["quality"]), "last_from": lo, "last_to": hi, "g_last": a["g"][-1]}]

    return M.parsed(files, run, ["content"], "sequence string, quality long, last_from long, last_to long, g_last long")


ABIF_SQL = f"""WITH {QUERIES_SQL}, n AS (SELECT *, length(sequence) AS n FROM queries WHERE length(sequence) >= 5)
SELECT query_id, sequence, list_sum(list_transform(range(0, n), lambda i: 30 + i % 20))::BIGINT AS quality, 6 * (n - 1) + 5 - 3 AS last_from, 6 * (n - 1) + 5 + 3 AS last_to, (6 * n + 8) * 3 % 500 AS g_last FROM n"""


def sequence_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several kinds parsed to tracks: flat files of two records, FASTA of one."""
    flat = _flat(spark, sf_dir).select(F.concat("file", F.lit(".gb")).alias("path"), F.col("text").cast("binary").alias("content"))
    fasta = corpus(spark, sf_dir).select(F.concat(F.lit("in/"), "file", F.lit(".fa")).alias("path"), M.to_fasta("file", "sequence").cast("binary").alias("content"))
    return M.tracks(flat.union(fasta)).select("file", "name", "molecule", "sequence", "circular", F.size("features").cast("long").alias("features"))


TRACKS_SQL = f"""WITH {CORPUS_SQL}
SELECT file || '.gb' AS file, file || ' · ' || file AS name, 'dna' AS molecule, sequence, circular, 2::BIGINT AS features FROM corpus WHERE sequence <> ''
UNION ALL SELECT file || '.gb', CASE WHEN sequence <> '' THEN file || ' · other' ELSE file END, 'dna', 'ACGTACGT', false, 0 FROM corpus
UNION ALL SELECT 'in/' || file || '.fa', file, 'dna', sequence, false, 0 FROM corpus WHERE sequence <> ''"""


def pasted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pasted tables of a passage's words: by tabs, by commas, as lines."""
    q = queries(spark, sf_dir)
    i, name = F.col("query_id"), F.concat(F.lit("p"), F.col("query_id").cast("string"))
    text = F.when(i % 3 == 0, F.concat(F.lit("name\tsequence\n"), name, F.lit("\t"), "sequence")).when(i % 3 == 1, F.concat(name, F.lit(" "), "sequence", F.lit("\n\n"))).otherwise(F.concat(F.lit("> "), name, F.lit("\r\n"), "sequence"))
    return M.pasted_table(q.select("query_id", text.alias("text")))


# A line of a name and less than five letters is no name and sequence, but one sequence.
PASTED_SQL = f"""WITH {QUERIES_SQL}, q AS (SELECT *, query_id % 3 = 1 AND length(sequence) < 5 AS one FROM queries)
SELECT query_id, CASE WHEN one THEN '' ELSE 'p' || query_id END AS name, CASE WHEN one THEN trim('p' || query_id || ' ' || sequence) ELSE sequence END AS sequence FROM q"""

QUERIES = {
    "scan_origin_bases": (scan_origin_bases, ORIGIN_SQL),
    "genbank_parse": (genbank_parse, GENBANK_SQL),
    "genbank_features": (genbank_features, FEATURES_SQL),
    "track_molecules": (track_molecules, MOLECULES_SQL),
    "parse_fasta": (parse_fasta, FASTA_SQL),
    "to_fasta": (to_fasta, TO_FASTA_SQL),
    "stockholm_rows": (stockholm_rows, STOCKHOLM_SQL),
    "parse_stockholm": (parse_stockholm, PARSED_SQL),
    "sniff_delimiter": (sniff_delimiter, SNIFF_SQL),
    "parse_delimited": (parse_delimited, DELIMITED_SQL),
    "xlsx_rows": (xlsx_rows, XLSX_SQL),
    "abif_read": (abif_read, ABIF_SQL),
    "sequence_tracks": (sequence_tracks, TRACKS_SQL),
    "pasted_table": (pasted_table, PASTED_SQL),
}
