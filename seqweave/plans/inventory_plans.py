"""Queries of inventories, carts, exports and file indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import inventory as I

from ..sources import exports as X
from .primer_plans import W, primer_search
from .workloads import queries, table

KEY = r"upper(regexp_replace({}, '\s+', '', 'g'))"


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_size <= 25")
    return p.select(F.col("p_partkey").alias("row_no"), F.col("p_brand").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name")).alias("sequence"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_size > 25")
    tail = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.col("p_type")))
    return p.select(F.col("p_partkey").alias("ord"), F.col("p_type").alias("name"), F.concat("p_name", tail).alias("sequence"), F.col("p_brand").alias("source_name"), "p_size")


INVENTORY_SQL = """inventory AS (SELECT p_partkey AS row_no, p_brand AS name, trim(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE ' ' || p_name END) AS sequence FROM part WHERE p_size <= 25)"""
DEDUPED_SQL = f"""deduped AS (SELECT {KEY.format("sequence")} AS key, arg_min(name, row_no) AS name, arg_min(sequence, row_no) AS sequence, min(row_no) AS row_no, count(*) AS copies FROM inventory GROUP BY 1)"""
ITEMS_SQL = """items AS (SELECT p_partkey AS ord, p_type AS name, p_name || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' ' || p_type END AS sequence, p_brand AS source_name, p_size FROM part WHERE p_size > 25)"""
ANNOTATED_SQL = f"""annotated AS (SELECT i.*, 'ok' AS match_status, d.key IS NOT NULL AS found, d.name AS match_name, d.sequence AS match_sequence
  FROM items i LEFT JOIN deduped d ON {KEY.format("i.sequence")} = d.key)"""


def inventory_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.dedupe(_inventory(spark, sf_dir))


def inventory_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.load_result(_inventory(spark, sf_dir))


def cart_inventory_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.annotate(_items(spark, sf_dir), _inventory(spark, sf_dir)).drop("p_size")


def cart_inventory_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory could not be read: nothing is called new."""
    return I.annotate(_items(spark, sf_dir), None, "missing").select("ord", "match_status", "found", "match_name")


def cart_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cart_summary(I.annotate(_items(spark, sf_dir), _inventory(spark, sf_dir)), "RED")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    path = F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("/maps/"), (i % 4).cast("string"), F.lit(".gb")))
    return e.select(F.col("user_id").alias("session"), i.alias("ord"), F.col("event_type").alias("name"), F.concat("event_type", F.when(i % 2 == 0, " ").otherwise(""), (i % 13).cast("string")).alias("sequence"), path.alias("source_path"))


EVENTS_SQL = f"""ev AS (SELECT user_id AS session, event_id AS ord, event_type AS name, {KEY.format("event_type || (event_id % 13)")} AS key,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE '/maps/' || (event_id % 4) || '.gb' END AS source_path FROM events)"""


def cart_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = I.cart_items(_events(spark, sf_dir), 12)
    return items.withColumn("also_found_in", F.array_join("also_found_in", ";"))


CART_SQL = f"""
WITH {EVENTS_SQL}, firsts AS (SELECT session, key, source_path, min(ord) AS ord, arg_min(name, ord) AS name FROM ev GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session, key ORDER BY ord) AS nth FROM firsts),
items AS (SELECT session, key, min(ord) AS ord, arg_min(name, ord) AS name, arg_min(source_path, ord) AS source_path,
  coalesce(string_agg(source_path, ';' ORDER BY ord) FILTER (nth > 1 AND source_path <> ''), '') AS also_found_in FROM ranked GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ord) AS place FROM items) WHERE place <= 12"""


def cart_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cart_counts(_events(spark, sf_dir), 12)


CAPACITY_SQL = f"""
WITH {EVENTS_SQL}, k AS (SELECT session, key, min(ord) AS ord, count(*) AS n FROM ev GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ord) AS place FROM k)
SELECT session, count(*) FILTER (place <= 12) AS added, (sum(n - 1) FILTER (place <= 12))::BIGINT AS duplicates,
  coalesce(sum(n) FILTER (place > 12), 0)::BIGINT AS refused FROM p GROUP BY session"""


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cart_items(_events(spark, sf_dir)).groupBy("session").agg(F.count(F.lit(1)).alias("items"))


COUNTS_SQL = f"WITH {EVENTS_SQL} SELECT session, count(DISTINCT key) AS items FROM ev GROUP BY session"


def cart_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory entries that are in the cart already."""
    inv = _inventory(spark, sf_dir).withColumn("key", S.sequence_key("sequence"))
    return inv.join(_items(spark, sf_dir).select(S.sequence_key("sequence").alias("key")).distinct(), "key", "left_semi").select("row_no", "key")


MARKS_SQL = f"WITH {INVENTORY_SQL}, {ITEMS_SQL} SELECT row_no, {KEY.format('sequence')} AS key FROM inventory WHERE {KEY.format('sequence')} IN (SELECT {KEY.format('sequence')} FROM items)"


def save_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    path = F.concat_ws("/", F.lit("/data"), F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")), F.concat(F.lit("r"), F.col("o_orderkey").cast("string"), F.lit(".ab1")))
    return I.save_folders(o.select(F.col("o_orderkey").alias("ord"), path.alias("path"), (F.col("o_orderkey") % 97 == 0).alias("is_reference")))


FOLDERS_SQL = """
WITH f AS (SELECT o_orderkey AS ord, '/data/c' || (o_custkey % 40) AS folder, o_orderkey % 97 = 0 AS is_reference FROM orders)
SELECT folder, bool_or(is_reference) AS holds_reference, count(*) FILTER (NOT is_reference) AS reads, row_number() OVER (ORDER BY min(ord)) AS place FROM f GROUP BY folder"""


def default_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next session name on a day that has some, and on one that has none."""
    names = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("name"))
    return I.default_session_name(names, F.lit("1995-03-15")).union(I.default_session_name(names, F.lit("1901-01-01")))


NAMES_SQL = """
WITH n AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS name FROM orders), d AS (SELECT unnest(['1995-03-15', '1901-01-01']) AS day)
SELECT day || CASE WHEN n > 0 THEN ' (' || (n + 1) || ')' ELSE '' END AS name FROM (SELECT day, (SELECT count(*) FROM n WHERE starts_with(name, day)) AS n FROM d)"""


def attached_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = primer_search(spark, sf_dir)
    return I.attached(hits, hits.where("anneal >= 20")).select("file", "name", "strand", "start", "end", "attached")


ATTACHED_SQL = f"""{W} SELECT file, name, strand, start, "end", (file, start, "end", strand) IN (SELECT (file, start, "end", strand) FROM primer_hits WHERE anneal >= 20) AS attached FROM primer_hits"""


def _export_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = I.annotate(_items(spark, sf_dir), _inventory(spark, sf_dir))
    i = F.col("ord")
    start = F.when(i % 5 != 0, i % 900)
    return items.select(
        "ord", F.when(i % 7 == 0, F.concat(F.lit('say "'), "name", F.lit('", ok'))).otherwise(F.col("name")).alias("name"), "sequence", F.when(i % 3 != 0, (i % 700) / 10.0).alias("tm"),
        "source_name", start.alias("start"), (start + 20).alias("end"), (i % 11 == 0).alias("wraps"), F.when(i % 2 == 0, -1).otherwise(1).alias("strand"), F.when(i % 13 != 0, "ok").otherwise("unknown").alias("match_status"),
        "found", "match_name", F.when(i % 6 == 0, "two\nlines").otherwise("").alias("note"),
    )


def export_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.csv_lines(_export_items(spark, sf_dir)).select("ord", "line")


_Q = """CASE WHEN regexp_matches({0}, '[",\\r\\n]') THEN '"' || replace({0}, '"', '""') || '"' ELSE {0} END"""
CSV_SQL = f"""
WITH {INVENTORY_SQL}, {DEDUPED_SQL}, {ITEMS_SQL}, {ANNOTATED_SQL},
e AS (SELECT ord, CASE WHEN ord % 7 = 0 THEN 'say "' || name || '", ok' ELSE name END AS name, sequence, length(sequence)::VARCHAR AS n,
  CASE WHEN ord % 3 <> 0 THEN regexp_replace(((ord % 700) / 10.0)::VARCHAR, '\\.0$', '') ELSE '' END AS tm, source_name,
  CASE WHEN ord % 5 <> 0 THEN (ord % 900 + 1) || '..' || (ord % 900 + 21) || CASE WHEN ord % 11 = 0 THEN ' (wraps origin)' ELSE '' END ELSE '' END AS at_,
  CASE WHEN ord % 2 = 0 THEN 'reverse' ELSE 'forward' END AS strand, CASE WHEN ord % 13 = 0 THEN 'unknown' WHEN found THEN coalesce(nullif(match_name, ''), 'yes') ELSE 'new' END AS inv,
  CASE WHEN ord % 6 = 0 THEN 'two' || chr(10) || 'lines' ELSE '' END AS note FROM annotated)
SELECT ord, concat_ws(',', {", ".join(_Q.format(c) for c in ("name", "sequence", "n", "tm", "source_name", "at_", "strand", "inv", "note"))}) AS line FROM e"""


def export_tsv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name"), F.col("text").alias("sequence"))
    return X.tsv_lines(items).select("doc_id", "line")


TSV_SQL = r"SELECT doc_id, source || chr(9) || regexp_replace(text, '[\t\r\n]+', ' ', 'g') AS line FROM documents"


def sequence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queries(spark, sf_dir)
    return q.select("query_id", F.concat_ws("\t", F.concat(F.lit("p"), F.col("query_id").cast("string")), "sequence").alias("line"))


LIST_SQL = "SELECT item_id AS query_id, 'p' || item_id || chr(9) || upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS line FROM benchmark"


def _listing(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("/maps/"), F.col("o_orderkey").cast("string"), F.lit(".gb")).alias("path"), (F.unix_timestamp("o_orderdate") + F.when(F.col("o_orderkey") % 7 == 0, shift).otherwise(0)).alias("mtime"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 11 == 0, shift).otherwise(0)).alias("size"), F.col("o_orderkey").alias("k"))


def index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _listing(spark, sf_dir, 0).where("k % 5 <> 0").drop("k")
    return I.refresh(now, _listing(spark, sf_dir, 1).where("k % 3 <> 0").drop("k"))


REFRESH_SQL = """
SELECT '/maps/' || o_orderkey || '.gb' AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'evict'
  WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN 'reuse' ELSE 'read' END AS action
FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 3 <> 0"""


def index_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_refresh(spark, sf_dir).where("action = 'evict'").select("path")


def locate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of one name in several folders; the nearest with equal content is found."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    folder = F.when(i % 9 == 0, "/.git").when(i % 4 == 0, "/a/b").when(i % 3 == 0, "/a").otherwise("")
    path = F.concat(F.lit("/root"), folder, F.lit("/"), F.col("source"), F.lit(".GB"))
    files = d.select(F.concat(path, F.lit("")).alias("path"), F.when(i % 4 == 0, 2).when(i % 3 == 0, 1).otherwise(0).alias("depth"), F.sha1(F.col("text").cast("binary")).alias("digest"))
    wanted = d.select(F.concat("source", F.lit(".gb")).alias("name"), F.sha1(F.col("text").cast("binary")).alias("digest")).distinct()
    return I.locate(wanted, files.distinct())


LOCATE_SQL = """
WITH d AS (SELECT *, sha1(text) AS digest, CASE WHEN doc_id % 9 = 0 THEN '/.git' WHEN doc_id % 4 = 0 THEN '/a/b' WHEN doc_id % 3 = 0 THEN '/a' ELSE '' END AS folder,
  CASE WHEN doc_id % 4 = 0 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS depth FROM documents),
f AS (SELECT source || '.gb' AS name, digest, '/root' || folder || '/' || source || '.GB' AS path, depth FROM d WHERE folder <> '/.git')
SELECT name, digest, path, depth::BIGINT AS depth FROM (SELECT *, row_number() OVER (PARTITION BY name, digest ORDER BY depth, path) AS n FROM f) WHERE n = 1"""


def digest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that several files share, by digest: the first file and how many there are."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("files")).where("files > 1")


DIGEST_SQL = "SELECT sha1(text) AS digest, min(doc_id) AS first_id, count(*) AS files FROM documents GROUP BY 1 HAVING count(*) > 1"

QUERIES = {
    "inventory_dedupe": (inventory_dedupe, f"WITH {INVENTORY_SQL}, {DEDUPED_SQL} SELECT * FROM deduped"),
    "inventory_load": (inventory_load, f"WITH {INVENTORY_SQL}, {DEDUPED_SQL} SELECT sum(copies)::BIGINT AS row_count, count(*) AS keys, (sum(copies) - count(*))::BIGINT AS duplicates FROM deduped"),
    "cart_inventory_join": (cart_inventory_join, f"WITH {INVENTORY_SQL}, {DEDUPED_SQL}, {ITEMS_SQL}, {ANNOTATED_SQL} SELECT * EXCLUDE (p_size) FROM annotated"),
    "cart_inventory_unknown": (cart_inventory_unknown, f"WITH {ITEMS_SQL} SELECT ord, 'unknown' AS match_status, false AS found, NULL::VARCHAR AS match_name FROM items"),
    "cart_summary": (cart_summary, f"""WITH {INVENTORY_SQL}, {DEDUPED_SQL}, {ITEMS_SQL}, {ANNOTATED_SQL} SELECT count(*) AS total,
      count(*) FILTER (contains(lower(name), 'red') OR contains(lower(sequence), 'red') OR contains(lower(source_name), 'red')) AS shown, count(*) FILTER (found) AS found, count(*) FILTER (NOT found) AS new FROM annotated"""),
    "cart_dedupe": (cart_dedupe, CART_SQL),
    "cart_capacity": (cart_capacity, CAPACITY_SQL),
    "session_counts": (session_counts, COUNTS_SQL),
    "cart_marks": (cart_marks, MARKS_SQL),
    "save_folders": (save_folders, FOLDERS_SQL),
    "default_names": (default_names, NAMES_SQL),
    "attached_flag": (attached_flag, ATTACHED_SQL),
    "export_csv_lines": (export_csv_lines, CSV_SQL),
    "export_tsv_lines": (export_tsv_lines, TSV_SQL),
    "sequence_list": (sequence_list, LIST_SQL),
    "index_refresh": (index_refresh, REFRESH_SQL),
    "index_evict": (index_evict, "SELECT '/maps/' || o_orderkey || '.gb' AS path FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0"),
    "locate_sources": (locate_sources, LOCATE_SQL),
    "digest_match": (digest_match, DIGEST_SQL),
}
