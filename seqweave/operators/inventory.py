"""Inventories and carts: keyed dedupe, annotation with three-valued status, accumulation with provenance, folders.

Order-dependent rules take an explicit ordinal column; nothing relies on the order of rows in a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import sequence_key, typed_sequence
from .tables import small

MAX_ITEMS = 200


def dedupe(entries: DataFrame) -> DataFrame:
    """key, name, sequence (verbatim), row_no of the first entry of each key, and copies.  Entries without sequence are skipped.

    entries: row_no, name, sequence.
    """
    rows = entries.withColumn("sequence", F.trim("sequence")).where(F.coalesce(F.col("sequence"), F.lit("")) != "")
    rows = rows.withColumn("key", sequence_key("sequence"))
    first = F.min_by(F.struct("name", "sequence", "row_no"), "row_no")
    return rows.groupBy("key").agg(first.alias("f"), F.count(F.lit(1)).alias("copies")).select("key", "f.name", "f.sequence", "f.row_no", "copies")


def load_result(entries: DataFrame) -> DataFrame:
    """One row: row_count, distinct keys, duplicates."""
    d = dedupe(entries)
    return d.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("keys")).withColumn("duplicates", F.col("row_count") - F.col("keys"))


def annotate(items: DataFrame, inventory: DataFrame | None, status: str = "ok") -> DataFrame:
    """items with match_status, found, match_name, match_sequence.

    status: how the inventory was read.  Unless it is 'ok' nothing is called new: 'disabled' stays so, the rest is 'unknown'.
    """
    if status != "ok" or inventory is None:
        shown = "disabled" if status == "disabled" else "unknown"
        none = F.lit(None).cast("string")
        return items.withColumns({"match_status": F.lit(shown), "found": F.lit(False), "match_name": none, "match_sequence": none})
    first = dedupe(inventory).select(F.col("key").alias("_key"), F.col("name").alias("match_name"), F.col("sequence").alias("match_sequence"))
    joined = items.withColumn("_own", sequence_key("sequence")).join(small(first), F.col("_own") == F.col("_key"), "left")
    return joined.withColumns({"match_status": F.lit("ok"), "found": F.col("_key").isNotNull()}).drop("_key", "_own")


def cart_items(events: DataFrame, most: int = MAX_ITEMS) -> DataFrame:
    """session, key, name, source_path, ord of the first event of each key, also_found_in; the first `most` keys of a session.

    events: session, ord, name, sequence, source_path.  also_found_in holds other distinct sources in order of arrival.
    """
    rows = events.withColumn("key", sequence_key("sequence")).where(F.col("key") != "")
    by_source = rows.groupBy("session", "key", "source_path").agg(F.min("ord").alias("ord"), F.min_by("name", "ord").alias("name"))
    seen = F.array_sort(F.collect_list(F.struct("ord", "source_path", "name")))
    items = by_source.groupBy("session", "key").agg(seen.alias("seen"))
    first = F.element_at("seen", 1)
    others = F.filter(F.slice("seen", 2, F.greatest(F.size("seen") - 1, F.lit(0))), lambda s: s["source_path"] != "")
    items = items.select("session", "key", first["ord"].alias("ord"), first["name"].alias("name"), first["source_path"].alias("source_path"), F.transform(others, lambda s: s["source_path"]).alias("also_found_in"))
    order = Window.partitionBy("session").orderBy("ord")
    return items.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)


def cart_counts(events: DataFrame, most: int = MAX_ITEMS) -> DataFrame:
    """session, added, duplicates, refused when events arrive in order."""
    rows = events.withColumn("key", sequence_key("sequence")).where(F.col("key") != "")
    keys = rows.groupBy("session", "key").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))
    every = keys.groupBy("session").agg(F.sum("n").alias("events"))
    order = Window.partitionBy("session").orderBy("ord")
    held = keys.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    held = held.groupBy("session").agg(F.count(F.lit(1)).alias("added"), F.sum("n").alias("n"))
    return every.join(held, "session").select("session", "added", (F.col("n") - F.col("added")).alias("duplicates"), (F.col("events") - F.col("n")).alias("refused"))


def cart_summary(annotated: DataFrame, text: str = "") -> DataFrame:
    """One row: total, shown (name, sequence or source holds the text), found, new."""
    shown = F.lit(False)
    for c in ("name", "sequence", "source_name"):
        shown = shown | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.lower())
    known = F.col("match_status") == "ok"
    return annotated.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(shown).alias("shown"), F.count_if(known & F.col("found")).alias("found"), F.count_if(known & ~F.col("found")).alias("new")
    )


def save_folders(files: DataFrame) -> DataFrame:
    """folder, holds_reference, reads, place (order of first appearance).  files: ord, path, is_reference."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    g = files.groupBy(folder.alias("folder")).agg(F.bool_or("is_reference").alias("holds_reference"), F.count_if(~F.col("is_reference")).alias("reads"), F.min("ord").alias("_first"))
    return g.withColumn("place", F.row_number().over(Window.orderBy("_first")).cast("long")).drop("_first")


def sessions(events: DataFrame) -> DataFrame:
    """session, created (its first event's ordinal), items, place: the newest first.  events: session, ord, sequence."""
    g = events.groupBy("session").agg(F.min("ord").alias("created"), F.count_distinct(sequence_key("sequence")).alias("items"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("created"), "session")).cast("long"))


def ingest(rows: DataFrame, reference: Column | None = None) -> DataFrame:
    """Pasted rows (row_no, name, sequence), each held to the rules of typed_sequence(): with label, bases and reason.

    Rows of which reason is null are good; the others come back with why they are refused.  Rows without name and sequence
    are passed over.  Good rows without a name are numbered sequence1, sequence2 ... in order, past names that are taken.
    A pasted table is small: its unnamed rows are numbered in one task.
    """
    name = F.trim(F.coalesce(F.col("name"), F.lit("")))
    held = rows.where((name != "") | (F.trim(F.coalesce(F.col("sequence"), F.lit(""))) != ""))
    held = held.withColumn("_t", typed_sequence("sequence", reference)).withColumns({"label": name, "bases": F.col("_t.sequence"), "reason": F.col("_t.reason")}).drop("_t")
    number = F.regexp_extract("label", r"^sequence([1-9]\d{0,8})$", 1)
    taken = F.array_sort(F.collect_set(F.when(F.col("reason").isNull() & (number != ""), number.cast("long"))).over(Window.partitionBy(F.lit(0))))
    unnamed = (F.col("label") == "") & F.col("reason").isNull()
    nth = F.count(F.when(unnamed, 1)).over(Window.orderBy("row_no"))
    free = F.aggregate("_taken", F.col("_nth"), lambda n, x: F.when(x <= n, n + 1).otherwise(n))
    numbered = held.withColumns({"_taken": taken, "_nth": nth})
    return numbered.withColumn("label", F.when(unnamed, F.concat(F.lit("sequence"), free.cast("string"))).otherwise(F.col("label"))).drop("_taken", "_nth")


def attached(hits: DataFrame, existing: DataFrame) -> DataFrame:
    """hits with attached: whether a primer lies at the same start, end and strand of the same file already."""
    own = existing.select(*[F.col(c).alias(f"_{c}") for c in ("file", "start", "end", "strand")]).distinct()
    same = [F.col(c) == F.col(f"_{c}") for c in ("file", "start", "end", "strand")]
    joined = hits.join(small(own), same, "left")
    return joined.withColumn("attached", F.col("_file").isNotNull()).drop("_file", "_start", "_end", "_strand")


def default_session_name(sessions: DataFrame, day: Column) -> DataFrame:
    """One row, name: the day, with the next number if sessions of that name exist."""
    n = F.count_if(F.col("name").startswith(day))
    return sessions.agg(n.alias("n")).select(F.when(F.col("n") > 0, F.concat(day, F.lit(" ("), (F.col("n") + 1).cast("string"), F.lit(")"))).otherwise(day).alias("name"))


# ---- file indexes


def refresh(listing: DataFrame, indexed: DataFrame) -> DataFrame:
    """path, action of every path: 'reuse' if time and size are unchanged, 'read' if new or changed, 'evict' if gone.

    listing, indexed: path, mtime, size.
    """
    a, b = listing.alias("a"), indexed.alias("b")
    joined = a.join(b, F.col("a.path") == F.col("b.path"), "full")
    same = (F.col("a.mtime") == F.col("b.mtime")) & (F.col("a.size") == F.col("b.size"))
    action = F.when(F.col("a.path").isNull(), "evict").when(F.coalesce(same, F.lit(False)), "reuse").otherwise("read")
    return joined.select(F.coalesce("a.path", "b.path").alias("path"), action.alias("action"))


def locate(wanted: DataFrame, listing: DataFrame, deepest: int = 4) -> DataFrame:
    """wanted (name, digest) with path: the nearest listed file of that name, whatever its case, whose digest is equal.

    listing: path, depth, digest.  Hidden folders and files, and folders of installed packages, are passed over.
    """
    skip = r"(^|/)(\.[^/]*|node_modules|__pycache__)(/|$)"
    files = listing.where(~F.col("path").rlike(skip) & (F.col("depth") <= deepest))
    files = files.select("path", "depth", F.col("digest").alias("_digest"), F.lower(F.regexp_extract("path", "([^/]*)$", 1)).alias("_name"))
    found = wanted.join(files, (F.lower("name") == F.col("_name")) & (F.col("digest") == F.col("_digest")))
    nearest = found.groupBy("name", "digest").agg(F.min(F.struct("depth", "path")).alias("b"))
    return nearest.select("name", "digest", "b.path", F.col("b.depth").cast("long").alias("depth"))
