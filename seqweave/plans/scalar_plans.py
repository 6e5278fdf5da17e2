"""Queries of the scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codons as C
from ..functions import sequences as S
from .search_plans import REV, aa
from .workloads import CORPUS_SQL, QUERIES_SQL, corpus, queries, table


def rev_comp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On raw texts too, whose other letters become N."""
    docs = table(spark, sf_dir, "benchmark")
    return docs.select("item_id", S.rev_comp(F.regexp_replace("text", "[^A-Za-z]", "")).alias("rc"))


REV_SQL = f"SELECT item_id, {REV.format('''regexp_replace(text, '[^A-Za-z]', '', 'g')''')} AS rc FROM benchmark"


def clean_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", S.clean("text").alias("query"))


CLEAN_SQL = r"SELECT item_id, upper(replace(regexp_replace(text, '\s+', '', 'g'), 'ß', 'SS')) AS query FROM benchmark"


def validate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        "item_id", S.bad_letters("text").alias("bad_dna"), S.bad_letters("text", protein=True).alias("bad_protein")
    )


VALIDATE_SQL = r"""
WITH q AS (SELECT item_id, upper(replace(regexp_replace(text, '\s+', '', 'g'), 'ß', 'SS')) AS q FROM benchmark),
letters AS (SELECT item_id, unnest(string_split(q, '')) AS c, generate_subscripts(string_split(q, ''), 1) AS i FROM q),
firsts AS (SELECT item_id, c, min(i) AS i FROM letters GROUP BY ALL),
bad AS (
  SELECT item_id, kind, string_agg(c, '' ORDER BY i) FILTER (n <= 5) AS s FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id, kind ORDER BY i) AS n FROM (
      SELECT *, 'dna' AS kind FROM firsts WHERE NOT contains('ACGTURYSWKMBDHVN', c)
      UNION ALL SELECT *, 'protein' FROM firsts WHERE NOT contains('ACDEFGHIKLMNPQRSTVWY*X', c))) GROUP BY ALL)
SELECT item_id, coalesce(d.s, '') AS bad_dna, coalesce(p.s, '') AS bad_protein
FROM q LEFT JOIN (SELECT * FROM bad WHERE kind = 'dna') d USING (item_id) LEFT JOIN (SELECT * FROM bad WHERE kind = 'protein') p USING (item_id)
"""


def guess_molecule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.guess_molecule("text").alias("molecule"))


GUESS_SQL = """
SELECT conv_id, turn, CASE WHEN word = '' OR length(regexp_replace(upper(word), '[^ACGTURYSWKMBDHVN]', '', 'g')) / length(word) > 0.9
  THEN 'dna' ELSE 'protein' END AS molecule FROM (SELECT conv_id, turn, text AS word FROM conversations)"""


def validate_typed_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations typed against a DNA or a protein reference."""
    rows = table(spark, sf_dir, "conversations")
    reference = F.when(F.col("turn") % 2 == 0, "dna").otherwise("protein")
    return rows.select("conv_id", "turn", S.typed_sequence("text", reference).alias("t")).select("conv_id", "turn", "t.sequence", "t.reason")


TYPED_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, turn % 2 = 1 AS protein, regexp_replace(upper(regexp_replace(
    replace(coalesce(text, ''), 'ß', 'SS'), '[\s\d]', '', 'g')), '\*$', '') AS s FROM conversations)
SELECT conv_id, turn, s AS sequence, CASE WHEN s = '' THEN 'empty' WHEN contains(s, '*') THEN 'stop inside'
  WHEN protein AND regexp_matches(s, '[^ACDEFGHIKLMNPQRSTVWYBXZJUO]') THEN 'not protein'
  WHEN NOT protein AND regexp_matches(s, '[^ACGTURYSWKMBDHVN]') THEN 'not dna'
  WHEN protein AND length(regexp_replace(s, '[^ACGTURYSWKMBDHVN]', '', 'g')) / length(s) > 0.9 THEN 'looks like dna' END AS reason
FROM t"""


def gc_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("file", S.gc_fraction("sequence").alias("gc"))


GC_SQL = f"WITH {CORPUS_SQL} SELECT file, CASE WHEN sequence <> '' THEN length(regexp_replace(sequence, '[^GC]', '', 'g')) / length(sequence) END AS gc FROM corpus"


def in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir).where(F.length("sequence") >= 30)
    n = F.length("sequence")
    p, a, b = ((F.col("doc_id") * k) % n for k in (7, 13, 29))
    return c.select("file", p.alias("p"), a.alias("start"), b.alias("end"), S.in_window(p, a, b).alias("inside"), S.wraps_origin(a, b, F.col("circular")).alias("wraps"))


WINDOW_SQL = f"""
WITH {CORPUS_SQL}, w AS (SELECT file, circular, (doc_id * 7) % length(sequence) AS p, (doc_id * 13) % length(sequence) AS a, (doc_id * 29) % length(sequence) AS b
  FROM corpus WHERE length(sequence) >= 30)
SELECT file, p, a AS start, b AS "end", CASE WHEN a <= b THEN p BETWEEN a AND b ELSE p >= a OR p <= b END AS inside, circular AND b < a AS wraps FROM w"""


def derive_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir).where(F.length("sequence") >= 30)
    n = F.length("sequence")
    a, b = (F.col("doc_id") * 13) % n, (F.col("doc_id") * 29) % n
    strand = F.when(F.col("doc_id") % 3 == 0, -1).otherwise(1)
    return c.select("file", S.derive_bases("sequence", a.cast("int"), b.cast("int"), strand, F.col("circular")).alias("bases"))


DERIVE_SQL = f"""
WITH {CORPUS_SQL}, w AS (SELECT *, ((doc_id * 13) % length(sequence))::INT AS a, ((doc_id * 29) % length(sequence))::INT AS b FROM corpus WHERE length(sequence) >= 30),
raw AS (SELECT file, doc_id, CASE WHEN b >= a THEN substr(sequence, a + 1, b - a + 1) WHEN circular THEN substr(sequence, a + 1) || substr(sequence, 1, b + 1)
  ELSE substr(sequence, b + 1, a - b + 1) END AS raw FROM w)
SELECT file, CASE WHEN doc_id % 3 = 0 THEN {REV.format("raw")} ELSE raw END AS bases FROM raw"""


def primer_tm(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queries(spark, sf_dir)
    tm = S.melting_point("sequence")
    return q.select("query_id", S.round_half_up(tm).alias("tm"), S.round_half_up(F.when(F.length("sequence").between(8, 100), tm)).alias("shown_tm"))


_H = " ".join(f"WHEN '{d}' THEN {v}" for d, v in S.DIMER_H.items())
_S = " ".join(f"WHEN '{d}' THEN {v}" for d, v in S.DIMER_S.items())


def tm_sql(rows: str) -> str:
    """A relation tms(key, tm) of rows(key, s); s upper case, null where there is no melting point."""
    return f"""tms AS (
  SELECT key, s, CASE WHEN length(s) >= 2 AND regexp_full_match(s, '[ACGT]+') THEN
    1 / (1 / (h * 1000 / (e + 1.987 * ln(5e-7))) + ((4.29 * (length(regexp_replace(s, '[^GC]', '', 'g')) / length(s)) - 3.95) * 1e-5 * ln(0.05)
      + power(9.4, -6) * ln(0.05) * ln(0.05))) - 273.15 END AS tm
  FROM (SELECT key, s,
    list_sum(list_transform(range(1, greatest(1, length(s))), lambda i: CASE substr(s, i::INT, 2) {_H} END))::DOUBLE
      + list_sum(list_transform([substr(s, 1, 1), substr(s, length(s)::INT, 1)], lambda c: CASE WHEN c IN ('G', 'C') THEN 0.1 ELSE 2.3 END))::DOUBLE AS h,
    list_sum(list_transform(range(1, greatest(1, length(s))), lambda i: CASE substr(s, i::INT, 2) {_S} END))::DOUBLE
      + list_sum(list_transform([substr(s, 1, 1), substr(s, length(s)::INT, 1)], lambda c: CASE WHEN c IN ('G', 'C') THEN -2.8 ELSE 4.1 END))::DOUBLE AS e
    FROM {rows}))"""


TM_SQL = f"""WITH {QUERIES_SQL}, k AS (SELECT query_id AS key, sequence AS s FROM queries), {tm_sql("k")}
SELECT key AS query_id, floor(tm * 10 + 0.5) / 10 AS tm, CASE WHEN length(s) BETWEEN 8 AND 100 THEN floor(tm * 10 + 0.5) / 10 END AS shown_tm FROM tms"""


def tm_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A noted temperature wins over the computed one; notes are numbers, prefixed numbers, words or null by turn."""
    q = queries(spark, sf_dir)
    i = F.col("query_id")
    note = F.when(i % 4 == 0, F.concat((i % 70).cast("string"), F.lit(".5"))).when(i % 4 == 1, F.concat((i % 70).cast("string"), F.lit(" C"))).when(i % 4 == 2, "warm")
    noted, computed = S.leading_number(note), S.melting_point("sequence")
    source = F.when(noted.isNotNull(), "notes").when(computed.isNotNull(), "computed")
    return q.select("query_id", S.round_half_up(F.coalesce(noted, computed)).alias("tm"), source.alias("tm_source"))


TM_SOURCE_SQL = f"""WITH {QUERIES_SQL}, k AS (SELECT query_id AS key, sequence AS s FROM queries), {tm_sql("k")},
noted AS (SELECT key, tm, CASE WHEN key % 4 = 0 THEN (key % 70) + 0.5 WHEN key % 4 = 1 THEN (key % 70)::DOUBLE END AS note FROM tms)
SELECT key AS query_id, floor(coalesce(note, tm) * 10 + 0.5) / 10 AS tm, CASE WHEN note IS NOT NULL THEN 'notes' WHEN tm IS NOT NULL THEN 'computed' END AS tm_source FROM noted"""


def primer_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "part").select(S.clean("p_name").alias("s"), "p_brand")
    primers = queries(spark, sf_dir).select(F.col("sequence").alias("s"), F.lit("benchmark").alias("p_brand")).union(q)
    ok = (F.length("s") >= 12) & F.col("s").rlike("^[ACGT]+$")
    return primers.groupBy(F.col("p_brand").alias("inventory")).agg(F.count_if(ok).alias("scanned"), F.count_if(~ok).alias("skipped"))


ELIGIBLE_SQL = rf"""WITH {QUERIES_SQL}, p AS (SELECT sequence AS s, 'benchmark' AS inventory FROM queries UNION ALL
  SELECT upper(regexp_replace(p_name, '\s+', '', 'g')), p_brand FROM part), e AS (SELECT *, regexp_full_match(s, '[ACGT]{{12,}}') AS ok FROM p)
SELECT inventory, count(*) FILTER (ok) AS scanned, count(*) FILTER (NOT ok) AS skipped FROM e GROUP BY inventory"""


def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey") % 3).alias("mismatches"), (F.col("l_suppkey") % 100).alias("compared"))
    return rows.select("l_orderkey", "l_linenumber", S.verdict("mismatches", "compared", F.lit(77)).alias("dna"), S.verdict("mismatches", "compared", F.lit(77), 24).alias("protein"))


VERDICT_SQL = """
WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 <> 0 THEN l_partkey % 3 END AS m, l_suppkey % 100 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber,
  CASE WHEN m IS NULL THEN NULL WHEN m > 0 OR c < 50 THEN 'mismatch' WHEN c = 77 THEN 'match' ELSE 'partial match' END AS dna,
  CASE WHEN m IS NULL THEN NULL WHEN m > 0 OR c < 24 THEN 'mismatch' WHEN c = 77 THEN 'match' ELSE 'partial match' END AS protein FROM r"""


def identity_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 90).alias("c"), (F.col("l_linenumber") % 5).alias("s"), (F.col("l_partkey") % 4).alias("g"))
    return rows.select("l_orderkey", "l_linenumber", S.identity_label("c", F.least("s", "c"), "g").alias("label"))


LABEL_SQL = """
WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey % 90 AS c, least(l_linenumber % 5, l_suppkey % 90) AS s, l_partkey % 4 AS g FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN c + g = 0 THEN '' ELSE format('{:.1f}', floor(1000 * (c - s) / (c + g)) / 10) || '% identical' END AS label FROM r"""


def translate_codon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.substr(F.regexp_replace("text", "[^A-Za-z]", ""), F.lit(1), F.lit(3)).alias("raw"), "text")
    return rows.select("item_id", S.translate_codon("raw").alias("raw_aa"), S.translate_codon(F.substr(F.regexp_replace("text", "[^ACGTUacgtu]", ""), F.lit(1), F.lit(3))).alias("aa"))


_T = "translate(upper(substr(regexp_replace(text, '[^{0}]', '', 'g'), 1, 3)), 'U', 'T')"
CODON_SQL = f"""WITH c AS (SELECT item_id, {_T.format("A-Za-z")} AS a, {_T.format("ACGTUacgtu")} AS b FROM benchmark)
SELECT item_id, CASE WHEN regexp_full_match(a, '[TCAG]{{3}}') THEN {aa("a")} ELSE '' END AS raw_aa, CASE WHEN regexp_full_match(b, '[TCAG]{{3}}') THEN {aa("b")} ELSE '' END AS aa FROM c"""


def codon_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.codon_usage(corpus(spark, sf_dir).withColumnRenamed("name", "organism"))


USAGE_SQL = f"""WITH {CORPUS_SQL},
codons AS (SELECT name AS organism, unnest(list_transform(range(0, length(sequence) // 3), lambda i: substr(sequence, (3 * i + 1)::INT, 3))) AS codon FROM corpus),
counts AS (SELECT organism, codon, {aa("codon")} AS aa, count(*) AS count FROM codons GROUP BY ALL)
SELECT organism, codon, aa, count, count / sum(count) OVER (PARTITION BY organism, aa) AS fraction, count * 1000 / sum(count) OVER (PARTITION BY organism) AS frequency FROM counts"""


def codons_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.codons_for(codon_usage(spark, sf_dir)).select("organism", "aa", "codon", "place")


CODONS_FOR_SQL = f"SELECT organism, aa, codon, row_number() OVER (PARTITION BY organism, aa ORDER BY fraction DESC, codon) AS place FROM ({USAGE_SQL})"


def codon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.codon_grid(spark)


GRID_SQL = f"""WITH g AS (SELECT i // 16 AS first, i // 4 % 4 AS second, i % 4 AS third, substr('TCAG', (i // 16 + 1)::INT, 1) || substr('TCAG', (i // 4 % 4 + 1)::INT, 1)
  || substr('TCAG', (i % 4 + 1)::INT, 1) AS codon FROM range(64) r(i)) SELECT *, {aa("codon")} AS aa FROM g"""


def apply_codon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codon written into each document's bases in their own case, on either strand, also across the origin."""
    raw = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^ACGTacgt]", "").alias("s")).where(F.length("s") >= 30)
    start, forward = ((F.col("doc_id") * 7 + F.length("s") - 2) % F.length("s")).cast("int"), F.col("doc_id") % 3 != 0
    s = F.when(F.col("doc_id") % 2 == 0, F.upper("s")).otherwise(F.col("s"))
    return raw.withColumn("s", s).select("doc_id", C.codon_at("s", start, forward).alias("codon"), C.apply_codon("s", start, forward, F.lit("gcu")).alias("edited"))


APPLY_SQL = f"""
WITH r AS (SELECT doc_id, regexp_replace(text, '[^ACGTacgt]', '', 'g') AS s FROM documents),
t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(s) ELSE s END AS s, length(s) AS n, (doc_id * 7 + length(s) - 2) % length(s) AS p, doc_id % 3 <> 0 AS fwd FROM r WHERE length(s) >= 30),
c AS (SELECT *, (p + 1) % n AS p1, (p + 2) % n AS p2 FROM t),
f AS (SELECT *, array_to_string(list_transform([p - 1, p - 2, p - 3, p2 + 1, p2 + 2, p2 + 3], lambda k: CASE WHEN k >= 0 THEN substr(s, (k + 1)::INT, 1) ELSE '' END), '') AS around,
  upper(substr(s, (p + 1)::INT, 1) || substr(s, (p1 + 1)::INT, 1) || substr(s, (p2 + 1)::INT, 1)) AS stored FROM c),
w AS (SELECT *, CASE WHEN regexp_matches(around, '[A-Z]') AND NOT regexp_matches(around, '[a-z]') THEN lower(CASE WHEN fwd THEN 'GCT' ELSE 'AGC' END)
  ELSE CASE WHEN fwd THEN 'GCT' ELSE 'AGC' END END AS word FROM f)
SELECT doc_id, CASE WHEN fwd THEN stored ELSE {REV.format("stored")} END AS codon,
  array_to_string(list_transform(string_split(s, ''), lambda x, i: CASE WHEN i - 1 = p THEN word[1] WHEN i - 1 = p1 THEN word[2] WHEN i - 1 = p2 THEN word[3] ELSE x END), '') AS edited
FROM w"""


def col_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.substr(F.regexp_replace("text", "[^A-Za-z]", ""), F.lit(1), F.lit(3)), F.col("item_id").cast("string")).alias("ref"))
    return refs.select("item_id", S.column_number("ref").alias("column"))


COLUMN_SQL = """
WITH r AS (SELECT item_id, upper(substr(regexp_replace(text, '[^A-Za-z]', '', 'g'), 1, 3)) AS l FROM benchmark)
SELECT item_id, list_sum(list_transform(string_split(l, ''), lambda c, i: (ascii(c) - 64) * power(26, length(l) - i)))::BIGINT - 1 AS "column" FROM r"""


def wrap_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with two locations, some of which only restate a range across the origin."""
    from ..functions import annotations as A

    c = corpus(spark, sf_dir).where(F.length("sequence") >= 40)
    n, i = F.length("sequence"), F.col("doc_id")
    start, end = n - 10 - (i % 5).cast("int"), (i % 7).cast("int") + 3
    tail = F.struct(start.alias("start"), (n - F.when(i % 4 == 0, 2).otherwise(1)).alias("end"))
    head = F.struct(F.lit(0).alias("start"), end.alias("end"))
    locations = F.when(i % 3 == 0, F.array(tail, head)).when(i % 3 == 1, F.array(head, tail))
    rows = c.select("file", start.alias("start"), end.alias("end"), n.alias("n"), locations.alias("locations"))
    restates = A.restates_origin(F.col("locations"), F.col("start"), F.col("end"), F.col("n"))
    dropped = F.when(~restates, F.col("locations"))
    return rows.select("file", restates.alias("restates"), F.size(F.coalesce(A.restore_locations(dropped, F.col("start"), F.col("end"), F.col("n")), F.array())).cast("long").alias("restored"))


WRAP_SQL = f"""WITH {CORPUS_SQL}, a AS (SELECT file, doc_id % 4 <> 0 AND doc_id % 3 <> 2 AS restates FROM corpus WHERE length(sequence) >= 40)
SELECT file, restates, 2::BIGINT AS restored FROM a"""


def copy_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queries(spark, sf_dir)
    return q.select("query_id", S.rev_comp("sequence").alias("reverse_complement"), S.translate_frame("sequence", 0).alias("translation"), S.translate_frame(S.rev_comp("sequence"), 0).alias("reverse_translation"))


_P = "array_to_string(list_transform(range(0, length({0}) // 3), lambda i: " + aa("substr({0}, (3 * i + 1)::INT, 3)") + "), '')"
COPY_SQL = f"""WITH {QUERIES_SQL}, r AS (SELECT query_id, sequence, {REV.format("sequence")} AS rc FROM queries)
SELECT query_id, rc AS reverse_complement, {_P.format("sequence")} AS translation, {_P.format("rc")} AS reverse_translation FROM r"""


QUERIES = {
    "rev_comp": (rev_comp, REV_SQL),
    "clean_query": (clean_query, CLEAN_SQL),
    "validate_query": (validate_query, VALIDATE_SQL),
    "guess_molecule": (guess_molecule, GUESS_SQL),
    "validate_typed_sequence": (validate_typed_sequence, TYPED_SQL),
    "gc_fraction": (gc_fraction, GC_SQL),
    "in_window": (in_window, WINDOW_SQL),
    "derive_bases": (derive_bases, DERIVE_SQL),
    "primer_tm": (primer_tm, TM_SQL),
    "tm_source": (tm_source, TM_SOURCE_SQL),
    "primer_eligibility": (primer_eligibility, ELIGIBLE_SQL),
    "verdict": (verdict, VERDICT_SQL),
    "identity_label": (identity_label, LABEL_SQL),
    "translate_codon": (translate_codon, CODON_SQL),
    "codon_usage": (codon_usage, USAGE_SQL),
    "codons_for": (codons_for, CODONS_FOR_SQL),
    "codon_grid": (codon_grid, GRID_SQL),
    "apply_codon": (apply_codon, APPLY_SQL),
    "col_to_index": (col_to_index, COLUMN_SQL),
    "wrap_locations": (wrap_locations, WRAP_SQL),
    "copy_transforms": (copy_transforms, COPY_SQL),
}
