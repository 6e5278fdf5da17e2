"""Queries of tables of hits, ingested rows, sessions and refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hits, inventory
from ..sources import formats as M
from .inventory_plans import EVENTS_SQL, _events
from .primer_plans import PRIMERS_SQL, _primers, primer_search
from .workloads import CORPUS_SQL, corpus, queries, table


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primer hits with their primer's sequence and two more columns of the inventory."""
    own = _primers(spark, sf_dir).select("ord", "sequence")
    extra = F.create_map(F.lit("File"), F.col("file"), F.lit("Odd"), F.when(F.col("ord") % 2 == 1, "odd").otherwise(""))
    return primer_search(spark, sf_dir).join(own, "ord").withColumn("extra", extra)


HITS_SQL = f"WITH {CORPUS_SQL}, {PRIMERS_SQL}, hits AS (SELECT h.*, CASE WHEN ord % 2 = 1 THEN 'ggggccccttttaaaa' ELSE '' END || q.sequence AS sequence FROM primer_hits h JOIN queries q ON q.query_id = ord)"


def hit_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default columns and the alias column, as shown."""
    return hits.table(_hits(spark, sf_dir), hits.visible(["File", "Odd"], alias="Odd"), keep=["file", "ord", "three_prime"])


DISPLAY_SQL = f"""{HITS_SQL}
SELECT file, ord, three_prime, (three_prime + 1) || CASE WHEN wraps THEN '↩' ELSE '' END AS pos, CASE WHEN strand = 1 THEN '+' ELSE '−' END AS str, name,
  tm::VARCHAR AS tm, anneal::VARCHAR AS anneal, CASE WHEN overhang > 0 THEN '+' || overhang ELSE '—' END AS tail, CASE WHEN ord % 2 = 1 THEN 'odd' ELSE '' END AS "Odd" FROM hits"""


def hit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen columns: locked ones can't be left out."""
    return hits.table(_hits(spark, sf_dir), hits.visible(["File", "Odd"], chosen=["File", "anneal"]), keep=["ord", "three_prime"])


COLUMNS_SQL = f"""{HITS_SQL}
SELECT ord, three_prime, (three_prime + 1) || CASE WHEN wraps THEN '↩' ELSE '' END AS pos, CASE WHEN strand = 1 THEN '+' ELSE '−' END AS str, name, anneal::VARCHAR AS anneal, file AS "File" FROM hits"""


def hit_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with a 1 in the name, sequence or shown file column, but not in one that isn't shown."""
    columns = hits.visible(["File", "Odd"], chosen=["File"])
    return hits.text_filter(_hits(spark, sf_dir), " P1", columns).unionByName(hits.text_filter(_hits(spark, sf_dir), "DOC12", columns)).unionByName(
        hits.text_filter(_hits(spark, sf_dir), "odd", columns)
    ).select("file", "name", "strand", "start")


FILTER_SQL = f"""{HITS_SQL}
SELECT file, name, strand, start FROM hits WHERE contains(name, 'p1') OR contains(lower(sequence), 'p1') OR contains(file, 'p1')
UNION ALL SELECT file, name, strand, start FROM hits WHERE contains(name, 'doc12') OR contains(file, 'doc12')"""


def ingest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages pasted as a batch: bases, prose, proteins with a stop, blanks; every third one without a name."""
    q = queries(spark, sf_dir).join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "query_id")
    i = F.col("query_id")
    sequence = F.when(i % 5 == 0, F.col("text")).when(i % 5 == 1, F.concat("sequence", F.lit("*"))).when(i % 5 == 2, F.lit(" ")).when(i % 5 == 3, F.concat(F.lit("1 "), F.lower("sequence"))).otherwise(F.concat("sequence", F.lit("*A")))
    name = F.when(i % 3 == 0, "").when(i % 7 == 1, F.concat(F.lit("sequence"), (i % 4 + 1).cast("string"))).otherwise(F.concat(F.lit("p"), i.cast("string")))
    rows = q.select(i.alias("row_no"), name.alias("name"), sequence.alias("sequence"))
    return inventory.ingest(rows, F.lit("dna")).select("row_no", "label", "bases", "reason")


INGEST_SQL = r"""
WITH q AS (SELECT item_id AS i, text, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS s FROM benchmark),
r AS (SELECT i, CASE WHEN i % 3 = 0 THEN '' WHEN i % 7 = 1 THEN 'sequence' || (i % 4 + 1) ELSE 'p' || i END AS name,
  CASE i % 5 WHEN 0 THEN text WHEN 1 THEN s || '*' WHEN 2 THEN ' ' WHEN 3 THEN '1 ' || lower(s) ELSE s || '*A' END AS seq FROM q),
t AS (SELECT i, name, regexp_replace(upper(regexp_replace(replace(seq, 'ß', 'SS'), '[\s\d]', '', 'g')), '\*$', '') AS b FROM r WHERE name <> '' OR trim(seq) <> ''),
c AS (SELECT *, CASE WHEN b = '' THEN 'empty' WHEN contains(b, '*') THEN 'stop inside' WHEN regexp_matches(b, '[^ACGTURYSWKMBDHVN]') THEN 'not dna' END AS reason FROM t),
free AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM range(1, 100000) f(n)
  WHERE 'sequence' || n NOT IN (SELECT name FROM c WHERE reason IS NULL)),
un AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM c WHERE reason IS NULL AND name = '')
SELECT c.i AS row_no, coalesce('sequence' || free.n, c.name) AS label, b AS bases, reason FROM c LEFT JOIN un ON un.i = c.i LEFT JOIN free ON free.k = un.k"""


def sessions_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.sessions(_events(spark, sf_dir))


SESSIONS_SQL = f"""WITH {EVENTS_SQL}, g AS (SELECT session, min(ord) AS created, count(DISTINCT key) AS items FROM ev GROUP BY session)
SELECT *, row_number() OVER (ORDER BY created DESC, session) AS place FROM g"""


def read_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns as reads against a DNA reference; every seventh can't be read."""
    from ..functions.sequences import guess_molecule

    rows = table(spark, sf_dir, "conversations")
    error = F.when(F.col("conv_id") % 7 == 0, "unreadable")
    return rows.select("conv_id", "turn", M.refusal(guess_molecule("text"), F.lit("dna"), error).alias("refusal"))


REFUSAL_SQL = """SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN 'unreadable'
  WHEN text <> '' AND length(regexp_replace(upper(text), '[^ACGTURYSWKMBDHVN]', '', 'g')) / length(text) <= 0.9 THEN 'protein against dna' END AS refusal FROM conversations"""


QUERIES = {
    "hit_display": (hit_display, DISPLAY_SQL),
    "hit_columns": (hit_columns, COLUMNS_SQL),
    "hit_text_filter": (hit_text_filter, FILTER_SQL),
    "ingest_rows": (ingest_rows, INGEST_SQL),
    "sessions_newest_first": (sessions_newest_first, SESSIONS_SQL),
    "read_refusal": (read_refusal, REFUSAL_SQL),
}
