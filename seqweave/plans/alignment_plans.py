"""Queries of the alignment operators, on pairs made from documents by a fixed rule."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment as A
from ..operators.tables import let
from .search_plans import REV
from .workloads import CORPUS_SQL, corpus, table

COMPLEMENT = ("ACGT", "TGCA")


def _aligned(d: int, sequence: str) -> tuple:
    """reference_row, read_row, n of a document's bases."""
    s, n = A.letters(sequence), len(sequence or "")
    i = np.arange(n)
    outside = (i < d % 17) | (i >= n - d % 19)
    inside = (i >= n // 3) & (i < n // 3 + d % 40)
    read = np.where(i % 53 == 7, A.COMPLEMENT[s], s)
    read[outside | inside | (i % 97 == 10)] = A.GAP
    return np.where(i % 101 == 50, A.GAP, s).astype(np.uint8).tobytes().decode("ascii"), read.astype(np.uint8).tobytes().decode("ascii"), n


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, name, reference_row, read_row, wraps: a read with ends missing, substitutions, insertions and deletions."""
    c = corpus(spark, sf_dir)
    d = F.col("doc_id")
    c = c.select("doc_id", F.concat(F.when(d % 5 == 0, "_R_").otherwise(""), "file").alias("name"), F.col("circular").alias("wraps"), "sequence")
    rows = A._map(c, _aligned, ["doc_id", "sequence"], "reference_row string, read_row string, n long")
    # Here and not before: the bases would be taken twice.
    return rows.where("n >= 60").select("doc_id", "name", "reference_row", "read_row", "wraps", "n")


PAIRS_SQL = f"""{CORPUS_SQL},
sized AS (SELECT *, length(sequence) AS n FROM corpus WHERE length(sequence) >= 60),
cells AS (SELECT doc_id, file, circular, n, generate_subscripts(string_split(sequence, ''), 1) - 1 AS i, unnest(string_split(sequence, '')) AS x FROM sized),
cols AS (SELECT doc_id, file, circular AS wraps, n, i, CASE WHEN i % 101 = 50 THEN '-' ELSE x END AS r,
  CASE WHEN i < doc_id % 17 OR i >= n - doc_id % 19 OR (i >= n // 3 AND i < n // 3 + doc_id % 40) OR i % 97 = 10 THEN '-'
    WHEN i % 53 = 7 THEN translate(x, 'ACGT', 'TGCA') ELSE x END AS q FROM cells)"""
PAIR_COLS_SQL = f"{PAIRS_SQL}, pair AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS c FROM cols WHERE NOT (r = '-' AND q = '-'))"


def split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.split_pairs(_pairs(spark, sf_dir)).select("doc_id", "name", "flipped", "reference_row", "read_row")


SPLIT_SQL = f"""WITH {PAIR_COLS_SQL} SELECT doc_id, file AS name, doc_id % 5 = 0 AS flipped, string_agg(r, '' ORDER BY c) AS reference_row, string_agg(q, '' ORDER BY c) AS read_row
FROM pair GROUP BY doc_id, file"""


def degap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", A.degap("read_row").alias("bases"))


DEGAP_SQL = f"WITH {PAIRS_SQL} SELECT doc_id, coalesce(string_agg(q, '' ORDER BY i) FILTER (q <> '-'), '') AS bases FROM cols GROUP BY doc_id"


def count_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.count_differences(A.split_pairs(_pairs(spark, sf_dir))).select("doc_id", "substitutions", "gaps", "compared", "mismatches", "identity")


DIFF_SQL = f"""
WITH {PAIR_COLS_SQL},
span AS (SELECT *, min(c) FILTER (q <> '-') OVER w AS a, max(c) FILTER (q <> '-') OVER w AS b FROM pair WINDOW w AS (PARTITION BY doc_id)),
inner_ AS (SELECT *, r <> '-' AND q = '-' AS del FROM span WHERE c BETWEEN a AND b),
runs AS (SELECT doc_id, count(*) AS len FROM (SELECT doc_id, c - row_number() OVER (PARTITION BY doc_id ORDER BY c) AS run FROM inner_ WHERE del) GROUP BY doc_id, run),
longest AS (SELECT doc_id, max(len) AS len FROM runs GROUP BY doc_id),
sums AS (SELECT doc_id, any_value(wraps) AS wraps, count(*) FILTER (r <> '-' AND q <> '-' AND r <> q) AS s, count(*) FILTER (r = '-' OR q = '-') AS g, count(*) FILTER (r <> '-' AND q <> '-') AS c
  FROM inner_ GROUP BY doc_id),
net AS (SELECT doc_id, s, g - CASE WHEN wraps THEN coalesce(len, 0) ELSE 0 END AS g, c FROM sums LEFT JOIN longest USING (doc_id))
SELECT doc_id, s AS substitutions, g AS gaps, c AS compared, s + g AS mismatches, CASE WHEN c > 0 THEN (c - s) / c ELSE 0.0 END AS identity FROM net
UNION ALL SELECT doc_id, 0, 0, 0, 0, 0.0 FROM (SELECT DISTINCT doc_id FROM pair) WHERE doc_id NOT IN (SELECT doc_id FROM net)"""


def count_differences_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the first and last tenths, across the origin, and a deleted stretch in the middle."""
    p = A.split_pairs(_pairs(spark, sf_dir))
    refs = F.length(A.degap("reference_row")).cast("long")
    tenth = F.floor(refs / 10)

    def span(a, b):
        return F.struct(a.alias("from"), b.alias("to"))

    p = p.withColumns({"covered": F.array(span(refs - tenth, tenth)), "deleted": F.array(span(tenth * 4, tenth * 5))})
    return A.count_differences_covered(p).select("doc_id", "substitutions", "gaps", "compared", "mismatches", "identity")


COVERED_SQL = f"""
WITH {PAIR_COLS_SQL},
ref AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS refs, row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS p FROM pair WHERE r <> '-'),
inside AS (SELECT * FROM ref WHERE p >= refs - refs // 10 OR p <= refs // 10 OR p BETWEEN refs // 10 * 4 AND refs // 10 * 5),
sums AS (SELECT doc_id, count(*) FILTER (q <> '-' AND r <> q) AS s, count(*) FILTER (q = '-') AS g, count(*) FILTER (q <> '-') AS c FROM inside GROUP BY doc_id)
SELECT doc_id, s AS substitutions, g AS gaps, c AS compared, s + g AS mismatches, CASE WHEN c > 0 THEN (c - s) / c ELSE 0.0 END AS identity FROM sums"""


def match_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.match_ranges(A.split_pairs(_pairs(spark, sf_dir)).select("doc_id", "reference_row", "read_row"))


RANGES_SQL = f"""
WITH {PAIR_COLS_SQL},
span AS (SELECT *, min(c) FILTER (q <> '-') OVER w AS a, max(c) FILTER (q <> '-') OVER w AS b FROM pair WINDOW w AS (PARTITION BY doc_id)),
runs AS (SELECT doc_id, c, r = q AS m, c - row_number() OVER (PARTITION BY doc_id, r = q ORDER BY c) AS run FROM span WHERE c BETWEEN a AND b)
SELECT doc_id, min(c)::BIGINT AS start, max(c)::BIGINT AS "end", m AS is_match FROM runs GROUP BY doc_id, m, run"""


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read of each document's own bases: a stretch that may cross the origin, some reversed, with substitutions."""
    c = corpus(spark, sf_dir).where(F.length("sequence") >= 30)
    n, d = F.length("sequence"), F.col("doc_id")
    start, size = (d * 7) % n, F.greatest(F.lit(12), F.floor(n * 2 / 3))
    text = F.substr(F.concat("sequence", "sequence"), (start + 1).cast("int"), size.cast("int"))
    read = F.array_join(F.transform(F.split(text, ""), lambda x, i: F.when(i % 41 == 40, F.translate(x, *COMPLEMENT)).otherwise(x)), "")
    from ..functions.sequences import rev_comp

    return c.select("doc_id", F.col("sequence").alias("reference"), F.when(d % 2 == 1, rev_comp(read)).otherwise(read).alias("read"), (d % 4 != 3).alias("circular"))


READS_SQL = f"""{CORPUS_SQL},
cut AS (SELECT doc_id, sequence AS reference, substr(sequence || sequence, ((doc_id * 7) % length(sequence) + 1)::INT, greatest(12, length(sequence) * 2 // 3)::INT) AS t FROM corpus WHERE length(sequence) >= 30),
mutated AS (SELECT doc_id, reference, array_to_string(list_transform(string_split(t, ''), lambda x, i: CASE WHEN (i - 1) % 41 = 40 THEN translate(x, 'ACGT', 'TGCA') ELSE x END), '') AS t FROM cut),
reads AS (SELECT doc_id, reference, CASE WHEN doc_id % 2 = 1 THEN {REV.format("t")} ELSE t END AS read, doc_id % 4 <> 3 AS circular FROM mutated)"""
ANCHOR_SQL = f"""{READS_SQL},
ks AS (SELECT *, length(reference) AS n, length(read) < 40 AS short, CASE WHEN length(read) < 40 THEN greatest(8, length(read) // 2) ELSE 20 END AS k FROM reads),
refk AS (SELECT doc_id, kmer, min(p) AS p FROM (SELECT doc_id, p, substr(reference, (p + 1)::INT, k::INT) AS kmer FROM (SELECT *, unnest(range(0, greatest(0, n - k + 1))) AS p FROM ks)) GROUP BY ALL),
two AS (SELECT doc_id, k, short, 1 AS strand, read AS t FROM ks UNION ALL SELECT doc_id, k, short, -1, {REV.format("read")} FROM ks),
seeds AS (SELECT t.doc_id, strand, i, p - i AS d FROM (SELECT *, unnest(range(0, greatest(0, length(t) - k + 1), CASE WHEN short THEN 1 ELSE 5 END)) AS i FROM two) t
  JOIN refk r ON t.doc_id = r.doc_id AND substr(t.t, (t.i + 1)::INT, t.k::INT) = r.kmer),
totals AS (SELECT doc_id, strand, count(*) AS total FROM seeds GROUP BY ALL),
best AS (SELECT doc_id, strand, total FROM totals QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, strand DESC) = 1),
own AS (SELECT s.*, b.total FROM seeds s JOIN best b USING (doc_id, strand)),
head AS (SELECT doc_id, list_sort(list(d ORDER BY i)[1:9]) AS h FROM own GROUP BY doc_id),
starts AS (SELECT doc_id, h[len(h) // 2 + 1] AS s FROM head),
votes AS (SELECT doc_id, d, count(*) AS v FROM own GROUP BY ALL),
folded AS (SELECT ks.doc_id, any_value(b.strand) AS strand, any_value(b.total) AS total, any_value(s.s) AS s, any_value(n) AS n, any_value(circular) AS circular, max(v) AS votes,
  coalesce(bool_or(v >= 3 AND abs(s.s - d - n) <= 100), false) AS near FROM ks LEFT JOIN best b USING (doc_id) LEFT JOIN starts s USING (doc_id) LEFT JOIN votes USING (doc_id) GROUP BY ks.doc_id),
anchors AS (SELECT doc_id, strand, CASE WHEN circular THEN (s % n + n) % n ELSE s END AS "offset", CASE WHEN strand IS NOT NULL THEN circular AND near END AS wraps, votes, total FROM folded)"""


def anchor_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.anchor_reads(_reads(spark, sf_dir)).drop("reference", "read", "circular")


def rotate_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.oriented_reads(A.anchor_reads(_reads(spark, sf_dir))).select("doc_id", "rotation", "placed")


ROTATE_SQL = f"""WITH {ANCHOR_SQL},
o AS (SELECT doc_id, CASE WHEN strand = -1 THEN {REV.format("read")} ELSE read END AS t,
  CASE WHEN coalesce(wraps, false) AND "offset" <> 0 THEN ((length(reference) - "offset") % length(read) + length(read)) % length(read) ELSE 0 END AS rotation FROM reads JOIN anchors USING (doc_id))
SELECT doc_id, rotation, substr(t, (rotation + 1)::INT) || substr(t, 1, rotation::INT) AS placed FROM o"""


def _doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair over the reference written twice: a read in up to three pieces from a place that may lie near the origin."""
    c = corpus(spark, sf_dir).where(F.length("sequence") >= 40)
    d = F.col("doc_id")

    def rows(s, n):
        letters, start = F.split(F.concat(s, s), ""), (d * 11) % n

        def read(x, i):
            return F.when((i >= start) & (i < start + F.floor(n * 3 / 4)) & ~((i >= start + 12) & (i < start + 12 + d % 9)) & (i % 37 != 5), x).otherwise("-")

        reference = F.transform(letters, lambda x, i: F.when(i % 83 == 41, "-").otherwise(x))
        return F.struct(F.array_join(reference, "").alias("doubled_row"), F.array_join(F.transform(letters, read), "").alias("read_row"))

    p = let(F.col("sequence"), lambda s: let(F.length(s), lambda n: rows(s, n)))
    rows = c.select("doc_id", p.alias("p")).select("doc_id", "p.doubled_row", "p.read_row")
    refs = F.length(A.degap("doubled_row"))
    return rows.withColumn("reference_length", F.floor((refs + 1) / 2).cast("long"))


DOUBLED_SQL = f"""{CORPUS_SQL},
sized AS (SELECT doc_id, sequence || sequence AS s, length(sequence) AS n FROM corpus WHERE length(sequence) >= 40),
cells AS (SELECT doc_id, n, (doc_id * 11) % n AS start, generate_subscripts(string_split(s, ''), 1) - 1 AS i, unnest(string_split(s, '')) AS x FROM sized),
cols AS (SELECT doc_id, i, CASE WHEN i % 83 = 41 THEN '-' ELSE x END AS r,
  CASE WHEN i >= start AND i < start + n * 3 // 4 AND NOT (i >= start + 12 AND i < start + 12 + doc_id % 9) AND i % 37 <> 5 THEN x ELSE '-' END AS q FROM cells),
walk AS (SELECT *, count(*) FILTER (r <> '-') OVER w - 1 AS rp, count(*) FILTER (q <> '-') OVER w - 1 AS qp, (count(*) FILTER (r <> '-') OVER (PARTITION BY doc_id) + 1) // 2 AS len
  FROM cols WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
placed AS (SELECT doc_id, len, rp % len AS p, arg_max(q, i) AS q, arg_max(qp, i) AS o FROM walk WHERE rp >= 0 AND r <> '-' AND q <> '-' GROUP BY ALL),
runs AS (SELECT doc_id, len, min(p) AS a, max(p) AS b, arg_min(o, p) AS o FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM placed) GROUP BY doc_id, len, run),
gaps AS (SELECT doc_id, o, (b + 1) % len AS a, (lead(a) OVER w - 1 + len) % len AS b, b + 1 <= lead(a) OVER w - 1 + len AS ok FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY o)),
ins AS (SELECT doc_id, count(*) FILTER (rp >= 0 AND r = '-' AND q <> '-') AS insertions FROM walk GROUP BY doc_id)"""


def fold_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.fold_reads(_doubled(spark, sf_dir))
    return f.select("doc_id", A.encode_ranges("covered").alias("covered"), A.encode_ranges("deleted").alias("deleted"), "insertions", "sequence", A.encode_runs("read_index").alias("read_index"))


_RANGE = "CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END"
FOLD_SQL = f"""WITH {DOUBLED_SQL},
cov AS (SELECT doc_id, string_agg({_RANGE}, ',' ORDER BY a) AS covered FROM runs GROUP BY doc_id),
del AS (SELECT doc_id, string_agg({_RANGE}, ',' ORDER BY o) AS deleted FROM gaps WHERE ok GROUP BY doc_id),
seq AS (SELECT doc_id, string_agg(q, '' ORDER BY p) AS sequence FROM placed GROUP BY doc_id),
steps AS (SELECT doc_id, p, o, CASE WHEN o = lag(o) OVER (PARTITION BY doc_id ORDER BY p) + 1 THEN 0 ELSE 1 END AS new FROM placed),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM steps),
idx AS (SELECT doc_id, string_agg(s || ':' || n, ',' ORDER BY run) AS read_index FROM (SELECT doc_id, run, arg_min(o, p) AS s, count(*) AS n FROM grouped GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, coalesce(covered, '') AS covered, coalesce(deleted, '') AS deleted, insertions, coalesce(sequence, '') AS sequence, coalesce(read_index, '') AS read_index
FROM ins LEFT JOIN cov USING (doc_id) LEFT JOIN del USING (doc_id) LEFT JOIN seq USING (doc_id) LEFT JOIN idx USING (doc_id)"""


def read_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded reads put back in their own order."""
    f = A.read_order(A.fold_reads(_doubled(spark, sf_dir)))
    return f.select("doc_id", F.col("read_sequence").alias("sequence"), "lost", A.encode_runs("new_index").alias("read_index"))


ORDER_SQL = f"""WITH {DOUBLED_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS k FROM placed),
steps AS (SELECT doc_id, p, k, CASE WHEN k = lag(k) OVER (PARTITION BY doc_id ORDER BY p) + 1 THEN 0 ELSE 1 END AS new FROM numbered),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM steps),
idx AS (SELECT doc_id, string_agg(s || ':' || n, ',' ORDER BY run) AS read_index FROM (SELECT doc_id, run, arg_min(k, p) AS s, count(*) AS n FROM grouped GROUP BY ALL) GROUP BY doc_id),
seq AS (SELECT doc_id, string_agg(q, '' ORDER BY o) AS sequence, max(o) + 1 - count(*) AS lost FROM placed GROUP BY doc_id)
SELECT doc_id, coalesce(sequence, '') AS sequence, coalesce(lost, 0)::BIGINT AS lost, coalesce(read_index, '') AS read_index FROM ins LEFT JOIN seq USING (doc_id) LEFT JOIN idx USING (doc_id)"""


def mutated_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.split_pairs(_pairs(spark, sf_dir))
    n = F.length(A.degap("reference_row")).cast("long")

    def feature(name, kind, a, b, strand):
        return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(strand).alias("strand"))

    features = F.array(
        feature("ahead", "CDS", n * 0 + 10, F.floor(n / 2), 1), feature("back", "cds", F.floor(n / 4), n - 5, -1),
        feature("round", "CDS", n - 20, F.floor(n / 8), 1), feature("other", "gene", n * 0, n - 1, 1),
    )
    return A.mutated_codons(p.select("doc_id", "reference_row", "read_row", n.alias("reference_length"), features.alias("features")))


MUTATED_SQL = f"""
WITH {PAIR_COLS_SQL},
walk AS (SELECT *, count(*) FILTER (r <> '-') OVER w - 1 AS rp, count(*) FILTER (q <> '-') OVER w - 1 AS qp, count(*) FILTER (r <> '-') OVER (PARTITION BY doc_id) AS len
  FROM pair WINDOW w AS (PARTITION BY doc_id ORDER BY c ROWS UNBOUNDED PRECEDING)),
map AS (SELECT doc_id, len, rp, qp, r <> q AS differs FROM walk WHERE r <> '-' AND q <> '-'),
feats AS (SELECT doc_id, any_value(len) AS len, unnest([{{'cds': 'ahead', 'a': 10, 'b': any_value(len) // 2, 's': 1}}, {{'cds': 'back', 'a': any_value(len) // 4, 'b': any_value(len) - 5, 's': -1}},
  {{'cds': 'round', 'a': any_value(len) - 20, 'b': any_value(len) // 8, 's': 1}}]) AS f FROM walk GROUP BY doc_id),
hit AS (SELECT m.doc_id, m.len, f.f.cds AS cds, f.f.s AS s, f.f.a AS a, f.f.b AS b, CASE WHEN f.f.s = 1 THEN ((m.rp - f.f.a) % m.len + m.len) % m.len ELSE ((f.f.b - m.rp) % m.len + m.len) % m.len END AS o
  FROM map m JOIN feats f USING (doc_id) WHERE differs AND CASE WHEN f.f.b >= f.f.a THEN m.rp BETWEEN f.f.a AND f.f.b ELSE m.rp >= f.f.a OR m.rp <= f.f.b END),
codon AS (SELECT DISTINCT doc_id, len, cds, s, a, b, o - o % 3 AS o FROM hit),
places AS (SELECT *, CASE WHEN s = 1 THEN ((a + o + k) % len + len) % len ELSE ((b - o - k) % len + len) % len END AS p FROM (SELECT *, unnest([0, 1, 2]) AS k FROM codon)),
read AS (SELECT p.doc_id, cds, s, o, min(p.p) AS first, count(m.qp) AS n, min(m.qp) AS start, max(m.qp) AS stop FROM places p LEFT JOIN map m ON p.doc_id = m.doc_id AND p.p = m.rp GROUP BY p.doc_id, cds, s, o)
SELECT DISTINCT doc_id, cds, s::INT AS strand, start, stop AS "end", first::BIGINT AS first FROM read WHERE n = 3 AND stop - start = 2"""


def encode_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first 200 numbers, every 7th left out, encoded and decoded."""
    d = table(spark, sf_dir, "documents")
    xs = F.filter(F.sequence(F.col("doc_id"), F.col("doc_id") + 200), lambda x: x % 7 != F.col("doc_id") % 5)
    rows = d.select("doc_id", xs.alias("xs")).withColumn("runs", A.encode_runs("xs"))
    return rows.select("doc_id", "runs", (A.decode_runs("runs") == F.col("xs")).alias("same"))


RUNS_SQL = """
WITH x AS (SELECT doc_id, unnest(range(doc_id, doc_id + 201)) AS x FROM documents), k AS (SELECT * FROM x WHERE x % 7 <> doc_id % 5),
g AS (SELECT doc_id, x - row_number() OVER (PARTITION BY doc_id ORDER BY x) AS run, x FROM k), r AS (SELECT doc_id, min(x) AS s, count(*) AS n FROM g GROUP BY doc_id, run)
SELECT doc_id, string_agg(s || ':' || n, ',' ORDER BY s) AS runs, true AS same FROM r GROUP BY doc_id"""


def decode_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    text = F.concat(i, F.lit("-"), (F.col("doc_id") + 9).cast("string"), F.lit(", x,"), i, F.lit(" ,3-"))
    return d.select("doc_id", F.explode(A.decode_ranges(text)).alias("r")).select("doc_id", F.col("r.from").alias("from"), F.col("r.to").alias("to"))


DECODE_SQL = """SELECT doc_id, doc_id AS "from", doc_id + 9 AS "to" FROM documents UNION ALL SELECT doc_id, doc_id, doc_id FROM documents"""


def codec_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = A.encode_fields({"lang": F.col("lang"), "name": F.concat_ws(" ", "source", "lang"), "odd": F.when(F.col("doc_id") % 2 == 1, "1"), "none": F.lit("")})
    rows = d.select("doc_id", text.alias("fields"))
    return rows.select("doc_id", "fields", F.try_element_at(A.decode_fields(F.concat("fields", F.lit(" loose"))), F.lit("name")).alias("name"), F.try_element_at(A.decode_fields(F.concat("fields", F.lit(" loose"))), F.lit("loose")).alias("loose"))


FIELDS_SQL = """SELECT doc_id, 'lang=' || lang || ' name=' || source || '_' || lang || CASE WHEN doc_id % 2 = 1 THEN ' odd=1' ELSE '' END AS fields, source || '_' || lang AS name, 'true' AS loose FROM documents"""


def coalesce_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of line numbers and quantities of each part, made one where they touch."""
    l = table(spark, sf_dir, "lineitem")
    start = F.col("l_orderkey") % 2000
    return A.coalesce_ranges(l.select(F.col("l_partkey").alias("part"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end")), ["part"])


COALESCE_SQL = """
WITH r AS (SELECT l_partkey AS part, l_orderkey % 2000 AS s, l_orderkey % 2000 + l_quantity::BIGINT AS e FROM lineitem),
o AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY part ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY part ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT part, min(s) AS start, max(e) AS "end" FROM g GROUP BY part, run"""

QUERIES = {
    "split_pairs": (split_pairs, SPLIT_SQL),
    "degap": (degap, DEGAP_SQL),
    "count_differences": (count_differences, DIFF_SQL),
    "count_differences_covered": (count_differences_covered, COVERED_SQL),
    "match_ranges": (match_ranges, RANGES_SQL),
    "anchor_reads": (anchor_reads, f"WITH {ANCHOR_SQL} SELECT * FROM anchors"),
    "rotate_reads": (rotate_reads, ROTATE_SQL),
    "fold_reads": (fold_reads, FOLD_SQL),
    "mutated_codons": (mutated_codons, MUTATED_SQL),
    "read_order": (read_order, ORDER_SQL),
    "encode_runs": (encode_runs, RUNS_SQL),
    "decode_ranges": (decode_ranges, DECODE_SQL),
    "codec_fields": (codec_fields, FIELDS_SQL),
    "coalesce_ranges": (coalesce_ranges, COALESCE_SQL),
}
