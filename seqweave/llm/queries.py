"""One query an operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, clustering, exact_dedup, html_text, lexical, license_scan, lsh_forest, mixing, quality_knn, quality_rules, simhash, toxicity, warc
from .common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(bpe.VOCABULARY)
    return bpe.encode_digests(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read(spark, sf_dir, "pages"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(read(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(read(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)] AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS i
  FROM docs GROUP BY source),
levels AS (
  SELECT *, 3 * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::BIGINT
           / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::BIGINT AS level
  FROM sizes WINDOW before AS (ORDER BY 3 * source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size,
         CASE WHEN w * level < cap THEN w * max(CASE WHEN w * level < cap THEN level END) OVER () ELSE cap::DOUBLE END AS target
  FROM levels),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM epochs
"""

# SHA-1 in base32: the hex digits as bits, taken five at a time.
OP2_SQL = r"""
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: format('{:04b}', strpos('0123456789abcdef', substr(hex, i::INT, 1)) - 1)), '') AS b
  FROM hashed),
named AS (
  SELECT page_id, payload_bytes, hex,
         array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (1 + 16 * substr(b, (5 * i + 1)::INT, 1)::INT + 8 * substr(b, (5 * i + 2)::INT, 1)::INT + 4 * substr(b, (5 * i + 3)::INT, 1)::INT
              + 2 * substr(b, (5 * i + 4)::INT, 1)::INT + substr(b, (5 * i + 5)::INT, 1)::INT)::INT, 1)), '') AS payload_digest,
         min(page_id) OVER (PARTITION BY hex) AS first_id
  FROM bits)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM named
"""

OP4_SQL = r"""
WITH docs AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
best AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM docs)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM best
"""


def _op5_sql() -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in sorted(license_scan.TEMPLATES.items()))
    split = "string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    leads = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, license_scan.SHINGLE))])
    return rf"""
WITH templates AS (SELECT * FROM (VALUES {rows}) t(license, text)),
template_words AS (SELECT license, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos FROM (
  SELECT license, {split.format("text")} AS words FROM templates)),
template_shingles AS (
  SELECT license, count(*) OVER (PARTITION BY license) AS span, shingle FROM (
    SELECT license, {leads} AS shingle FROM template_words WINDOW o AS (PARTITION BY license ORDER BY pos)) WHERE shingle IS NOT NULL),
template_sizes AS (SELECT license, count(DISTINCT shingle) AS n FROM template_shingles GROUP BY license),
doc_words AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos FROM (
  SELECT doc_id, {split.format("coalesce(text, '')")} AS words FROM documents)),
doc_shingles AS (
  SELECT doc_id, pos, {leads} AS shingle FROM doc_words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
hits AS (
  SELECT DISTINCT d.doc_id, t.license, d.pos, d.shingle, t.span FROM doc_shingles d JOIN template_shingles t USING (shingle)),
windows AS (
  SELECT *, unnest([pos // span, pos // span - 1]) AS part FROM hits),
shares AS (
  SELECT doc_id, license, part, count(DISTINCT shingle) / any_value(n) AS containment, min(pos) AS pos
  FROM windows JOIN template_sizes USING (license) WHERE part >= 0 GROUP BY doc_id, license, part)
SELECT doc_id, license, max(containment) AS containment, min(pos)::BIGINT AS first_word
FROM shares WHERE containment >= {license_scan.MIN_CONTAINMENT} GROUP BY doc_id, license
"""


def _op11_sql() -> str:
    """Every distance to every centroid, a round after the other."""
    steps = [r"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN floor(64 * x::DOUBLE)::BIGINT END) AS p FROM embeddings WHERE len(embedding) = 64),
points AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, p, sha256('1:' || vec_id::VARCHAR) AS h FROM whole WHERE list_count(p) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, p) - 1 AS c, p FROM points ORDER BY h NULLS LAST, p LIMIT 16)"""]
    for k in range(clustering.ROUNDS + 1):
        steps.append(rf"""a{k} AS MATERIALIZED (
  SELECT r, arg_min(c, d * 16 + c) AS c, min(d) AS d FROM (
    SELECT r, c, list_sum(list_transform(list_zip(v.p, c{k}.p), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM points v, c{k})
  GROUP BY r)""")
        if k < clustering.ROUNDS:
            steps.append(rf"""s{k} AS (
  SELECT c, i, CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS x FROM (
    SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
      SELECT c, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM a{k} JOIN points USING (r)) GROUP BY c, i)),
c{k + 1} AS MATERIALIZED (
  SELECT c{k}.c, coalesce(m.p, c{k}.p) AS p FROM c{k} LEFT JOIN (SELECT c, list(x ORDER BY i) AS p FROM s{k} GROUP BY c) m USING (c))""")
    k = clustering.ROUNDS
    return ",\n".join(steps) + rf"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c{k}.p, ',')) AS centroid_sha256
FROM a{k} JOIN points USING (r) JOIN c{k} USING (c)
"""


OP12_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
size AS (SELECT count(*) AS documents, sum(len(terms))::BIGINT AS length FROM words WHERE len(terms) > 0),
postings AS (
  SELECT r, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, unnest(terms) AS term, len(terms) AS n FROM words) GROUP BY r, doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, size GROUP BY term, documents),
items AS (
  SELECT DISTINCT i, item_id, term FROM (
    SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark))),
scores AS (
  SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // length))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN postings USING (term), size GROUP BY i, item_id, r, doc_id),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

# Pairs meet on a shared shingle; a set is named by its text of sorted shingles, so that equal sets are one.
OP13_SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT r, hash(array_to_string(w[k:k + 3], ' ')) AS s FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS k FROM words WHERE len(w) > 0)),
sets AS MATERIALIZED (SELECT r, count(*) AS n, sha256(string_agg(s::VARCHAR, ',' ORDER BY s)) AS name FROM shingles GROUP BY r),
one AS MATERIALIZED (SELECT name, min(r) AS r, any_value(n) AS n FROM sets GROUP BY name),
own AS (SELECT name, s, n FROM shingles JOIN one USING (r)),
shared AS (SELECT a.name AS a, b.name AS b, a.n AS n, b.n AS m, count(*) AS k FROM own a JOIN own b USING (s) WHERE a.name < b.name GROUP BY ALL),
linked AS (SELECT a, b FROM shared WHERE 100 * k >= 80 * (n + m - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT name AS a, name AS b FROM one UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
least AS (SELECT reach.a AS name, min(doc_id) AS component_id FROM reach JOIN sets ON sets.name = reach.b JOIN words ON words.r = sets.r GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id,
       CASE WHEN n IS NULL THEN true ELSE doc_id IS NOT DISTINCT FROM component_id END AS kept
FROM words LEFT JOIN sets USING (r) LEFT JOIN least USING (name)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_warc": op2_warc,
        "op3_toxicity": op3_toxicity,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_license_scan": op5_license_scan,
        "op6_quality_rules": op6_quality_rules,
        "op7_quality_knn": op7_quality_knn,
        "op8_simhash": op8_simhash,
        "op9_bpe": op9_bpe,
        "op10_html_text": op10_html_text,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_lexical_search": op12_lexical_search,
        "op13_lsh_forest": op13_lsh_forest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": OP1_SQL,
        "op2_warc": OP2_SQL,
        "op4_exact_dedup": OP4_SQL,
        "op5_license_scan": _op5_sql(),
        "op11_centroid_clustering": _op11_sql(),
        "op12_lexical_search": OP12_SQL,
        "op13_lsh_forest": OP13_SQL,
    }
