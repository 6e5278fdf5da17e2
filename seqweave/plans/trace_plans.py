"""Queries of the trace operators, on arrays made from embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import traces as T
from ..operators.tables import let
from .workloads import CORPUS_SQL, corpus, spread, table


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, quality: poor ends, mostly good inside."""
    e = table(spark, sf_dir, "embeddings")

    def q(x, i):
        base = F.pmod(F.floor(F.abs(x.cast("double")) * 1000).cast("int"), F.lit(60))
        return F.when((i < F.col("vec_id") % 9) | (base < 8), base % 20).otherwise(base % 20 + 30)

    return e.select("vec_id", F.transform("embedding", q).alias("quality"))


QUALITY_SQL = """
cells AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, floor(abs(unnest(embedding)::DOUBLE) * 1000)::INT % 60 AS b FROM embeddings),
quality AS (SELECT vec_id, i, CASE WHEN i < vec_id % 9 OR b < 8 THEN b % 20 ELSE b % 20 + 30 END AS q, count(*) OVER (PARTITION BY vec_id) AS n FROM cells)"""


def quality_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quality(spark, sf_dir).select("vec_id", T.quality_span("quality", 20).alias("s"), F.size("quality").alias("n"))
    kept = F.col("s.end") > F.col("s.start")
    return rows.select("vec_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.when(kept, F.col("n") - (F.col("s.end") - F.col("s.start") + 1)).otherwise(0).cast("long").alias("removed"))


TRIM_SQL = f"""
WITH {QUALITY_SQL},
shares AS (SELECT *, avg((q >= 20)::INT) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead,
  avg((q >= 20)::INT) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS behind FROM quality),
spans AS (SELECT vec_id, any_value(n) AS n, coalesce(min(i) FILTER (q >= 20 AND ahead >= 0.8), any_value(n) - 1) AS s, coalesce(max(i) FILTER (q >= 20 AND behind >= 0.8), 0) AS e FROM shares GROUP BY vec_id)
SELECT vec_id, s AS start, greatest(s, e) AS "end", CASE WHEN e > s THEN n - (e - s + 1) ELSE 0 END AS removed FROM spans"""


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, base_traces (of 3 to 6 samples a base), base_calls, quality."""
    e = spread(table(spark, sf_dir, "embeddings"))

    def traces(xs):
        def one(x, i):
            def channel(k):
                return F.transform(F.sequence(F.lit(0), (F.col("vec_id") % 4 + 2).cast("int")), lambda j: F.pmod(F.floor(F.abs(x.cast("double")) * 5000).cast("int") * (k + 1) + j * (i + 7), F.lit(900)))

            return F.struct(*[channel(k).alias(c) for k, c in enumerate(T.CHANNELS)])

        return F.transform(xs, one)

    calls = F.transform("embedding", lambda x, i: F.substr(F.lit("ATGCN"), ((i * 3 + F.col("vec_id")) % 5 + 1).cast("int"), F.lit(1)))
    return e.select("vec_id", traces(F.col("embedding")).alias("base_traces"), calls.alias("base_calls"), F.transform("embedding", lambda x, i: (i * 5) % 41).alias("quality"))


TRACES_SQL = """
base AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, floor(abs(unnest(embedding)::DOUBLE) * 5000)::INT AS v, len(embedding) AS n FROM embeddings),
traces AS (SELECT vec_id, i, n, substr('ATGCN', ((i * 3 + vec_id) % 5 + 1)::INT, 1) AS call, (i * 5) % 41 AS q,
  {c: list_transform(range(0, vec_id % 4 + 3), lambda j: (v * {k} + j * (i + 7)) % 900)} FROM base)"""
TRACES_SQL = TRACES_SQL.replace(
    "{c: list_transform(range(0, vec_id % 4 + 3), lambda j: (v * {k} + j * (i + 7)) % 900)}",
    ", ".join(f"list_transform(range(0, vec_id % 4 + 3), lambda j: (v * {k + 1} + j * (i + 7)) % 900) AS {c}" for k, c in enumerate(T.CHANNELS)),
)


def trace_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flipped, rotated by three and every other base picked, as a read follows its alignment."""
    t = _traces(spark, sf_dir)
    flipped, calls, quality = T.reverse_complement(F.col("base_traces"), F.col("base_calls"), F.col("quality"))
    index = let(F.size("quality"), lambda n: F.sequence(F.lit(0), n - 1, F.lit(2)))
    rows = t.select("vec_id", *[T.pick(T.roll(x, F.lit(3)), index).alias(c) for x, c in ((flipped, "t"), (calls, "calls"), (quality, "q"))])
    first = F.element_at("t", 1)
    return rows.select("vec_id", F.array_join("calls", "").alias("calls"), F.array_join("q", ",").alias("quality"), F.array_join(first["a"], ",").alias("a"), F.array_join(first["g"], ",").alias("g"))


TRANSFORM_SQL = f"""
WITH {TRACES_SQL}, flipped AS (SELECT *, n - 1 - i AS r FROM traces), rolled AS (SELECT *, (r - 3 + n) % n AS p FROM flipped)
SELECT vec_id, string_agg(translate(call, 'ATGCN', 'TACGN'), '' ORDER BY p) AS calls, string_agg(q, ',' ORDER BY p) AS quality,
  array_to_string(list_reverse(arg_min(t, p)), ',') AS a, array_to_string(list_reverse(arg_min(c, p)), ',') AS g FROM rolled WHERE p % 2 = 0 GROUP BY vec_id"""


def follow_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces as their rows have them: every other one flipped, turned by its number, every third folded to its even places."""
    t, v = _traces(spark, sf_dir), F.col("vec_id")
    index = F.when(v % 3 == 0, let(F.size("quality"), lambda n: F.sequence(F.lit(0), n - 1, F.lit(2))))
    rows = T.follow_alignment(t.withColumns({"strand": F.when(v % 2 == 0, -1).otherwise(1), "rotation": (v % 5).cast("int"), "read_index": index}))
    first = F.element_at("base_traces", 1)
    return rows.select("vec_id", F.array_join("base_calls", "").alias("calls"), F.array_join("quality", ",").alias("quality"), F.array_join(first["t"], ",").alias("t"))


FOLLOW_SQL = f"""
WITH {TRACES_SQL}, flipped AS (SELECT *, CASE WHEN vec_id % 2 = 0 THEN n - 1 - i ELSE i END AS r FROM traces), rolled AS (SELECT *, (r - vec_id % 5 + 5 * n) % n AS p FROM flipped)
SELECT vec_id, string_agg(CASE WHEN vec_id % 2 = 0 THEN translate(call, 'ATGCN', 'TACGN') ELSE call END, '' ORDER BY p) AS calls, string_agg(q, ',' ORDER BY p) AS quality,
  CASE WHEN vec_id % 2 = 0 THEN array_to_string(list_reverse(arg_min(a, p)), ',') ELSE array_to_string(arg_min(t, p), ',') END AS t
FROM rolled WHERE vec_id % 3 <> 0 OR p % 2 = 0 GROUP BY vec_id"""


def smooth_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.smooth(_traces(spark, sf_dir).select("vec_id", "base_traces")).select("vec_id", F.posexplode("base_traces").alias("i", "b"))
    return t.select("vec_id", F.col("i").cast("long").alias("i"), *[F.array_join(F.col("b")[c], ",").alias(c) for c in T.CHANNELS])


_EASED = "array_to_string(list_transform(range(0, 16), lambda k: floor({0}[(floor(k / 15 * (len({0}) - 1)) + 1)::INT] * (1 - (1 - cos(pi() * (k / 15 * (len({0}) - 1) - floor(k / 15 * (len({0}) - 1))))) / 2) + {0}[(least(len({0}) - 1, floor(k / 15 * (len({0}) - 1)) + 1) + 1)::INT] * ((1 - cos(pi() * (k / 15 * (len({0}) - 1) - floor(k / 15 * (len({0}) - 1))))) / 2) + 0.5)::INT), ',') AS {0}"
SMOOTH_SQL = f"WITH {TRACES_SQL} SELECT vec_id, i, {', '.join(_EASED.format(c) for c in T.CHANNELS)} FROM traces"


def trace_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks a few samples apart, from the running sum of an embedding."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    from pyspark.sql import Window

    step = F.floor(F.abs(F.col("x").cast("double")) * 40) + 2
    peak = F.sum(step).over(Window.partitionBy("vec_id").orderBy("i"))
    rows = e.select(F.col("vec_id").alias("read_id"), F.col("i").cast("long").alias("i"), peak.cast("long").alias("peak"))
    return T.trace_windows(rows.withColumn("samples", F.max("peak").over(Window.partitionBy("read_id")) + 3))


WINDOWS_SQL = """
WITH c AS (SELECT vec_id AS read_id, generate_subscripts(embedding, 1) - 1 AS i, floor(abs(unnest(embedding)::DOUBLE) * 40) + 2 AS step FROM embeddings),
p AS (SELECT read_id, i, sum(step) OVER (PARTITION BY read_id ORDER BY i)::BIGINT AS peak FROM c),
a AS (SELECT *, max(peak) OVER (PARTITION BY read_id) + 3 AS samples, lag(peak) OVER w AS b, lead(peak) OVER w AS f, count(*) OVER (PARTITION BY read_id) AS n,
  max(peak) OVER (PARTITION BY read_id) - min(peak) OVER (PARTITION BY read_id) AS reach FROM p WINDOW w AS (PARTITION BY read_id ORDER BY i)),
s AS (SELECT *, CASE WHEN n > 1 THEN greatest(1, floor(reach / (n - 1) + 0.5)) ELSE 2 END AS spacing FROM a)
SELECT read_id, i, greatest(0, floor((coalesce(b, peak - spacing) + peak) / 2 + 0.5))::BIGINT AS "from", least(samples, floor((peak + coalesce(f, peak + spacing)) / 2 + 0.5))::BIGINT AS "to" FROM s"""


def fit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traces(spark, sf_dir).select("vec_id", F.round(T.fit_scale(F.col("base_traces"), F.col("base_calls"), 35.0), 9).alias("scale"))


FIT_SQL = f"""
WITH {TRACES_SQL}, h AS (SELECT vec_id, list_max(CASE call WHEN 'A' THEN a WHEN 'T' THEN t WHEN 'G' THEN g WHEN 'C' THEN c END) AS h FROM traces),
s AS (SELECT vec_id, list_sort(list(h)) AS hs FROM h WHERE h > 0 GROUP BY vec_id)
SELECT vec_id, CASE WHEN coalesce(len(hs), 0) < 10 THEN 0.05 ELSE round(35.0 / (hs[(least(len(hs) - 1, floor(len(hs) * 0.75)) + 1)::INT] * 1.6), 9) END AS scale FROM (SELECT DISTINCT vec_id FROM traces) LEFT JOIN s USING (vec_id)"""


def move_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three features of each document's bases carried along with a read that starts at a third and skips every 50th base."""
    c = corpus(spark, sf_dir).where(F.length("sequence") >= 60)
    d = F.col("doc_id")

    def rows(n):
        def feature(name, a, b, strand, locations=None):
            none = F.lit(None).cast("array<struct<start: bigint, end: bigint>>")
            return F.struct(F.lit(name).alias("name"), a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(strand).alias("strand"), (none if locations is None else locations).alias("locations"))

        two = F.array(*[F.struct(a.cast("long").alias("start"), b.cast("long").alias("end")) for a, b in ((n * 0 + 5, n * 0 + 15), (n - 30, n - 20))])
        features = F.array(feature("whole", F.floor(n / 5), F.floor(n / 2), 1), feature("round", n - 10, n * 0 + 12, -1), feature("two", n * 0 + 5, n - 20, 1, two))
        index = F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda i: ((i + F.floor(n / 3)) % n).cast("long")), lambda i: i % 50 != 49)
        return F.struct(features.alias("annotations"), index.alias("read_index"), n.cast("long").alias("length"))

    p = c.select("doc_id", F.when(d % 2 == 0, 1).otherwise(-1).alias("strand"), let(F.length("sequence"), rows).alias("p"))
    return T.move_annotations(p.select("doc_id", "p.annotations", "strand", "p.read_index", "p.length"))


MOVE_SQL = f"""
WITH {CORPUS_SQL}, n AS (SELECT doc_id, length(sequence) AS n, doc_id % 2 = 1 AS back FROM corpus WHERE length(sequence) >= 60),
f AS (SELECT doc_id, n, back, unnest([{{'name': 'whole', 's': n // 5, 'e': n // 2, 'd': 1}}, {{'name': 'round', 's': n - 10, 'e': n - 1, 'd': -1}}, {{'name': 'round', 's': 0, 'e': 12, 'd': -1}},
  {{'name': 'two', 's': 5, 'e': 15, 'd': 1}}, {{'name': 'two', 's': n - 30, 'e': n - 20, 'd': 1}}]) AS f FROM n),
flip AS (SELECT doc_id, n, f.f.name AS name, CASE WHEN back THEN n - 1 - f.f.e ELSE f.f.s END AS s, CASE WHEN back THEN n - 1 - f.f.s ELSE f.f.e END AS e, CASE WHEN back THEN -f.f.d ELSE f.f.d END AS d FROM f),
idx AS (SELECT doc_id, b, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS col FROM (SELECT doc_id, i, (i + n // 3) % n AS b FROM (SELECT doc_id, n, unnest(range(0, n)) AS i FROM n)) WHERE b % 50 <> 49),
cols AS (SELECT DISTINCT f.doc_id, name, d, col FROM flip f JOIN idx x ON f.doc_id = x.doc_id AND x.b BETWEEN f.s AND f.e),
runs AS (SELECT *, col - row_number() OVER (PARTITION BY doc_id, name ORDER BY col) AS run FROM cols)
SELECT doc_id, name, min(col) AS start, max(col) AS "end", d::INT AS strand FROM runs GROUP BY doc_id, name, d, run"""

QUERIES = {
    "quality_trim": (quality_trim, TRIM_SQL),
    "follow_alignment": (follow_alignment, FOLLOW_SQL),
    "trace_transform": (trace_transform, TRANSFORM_SQL),
    "smooth_trace": (smooth_trace, SMOOTH_SQL),
    "trace_windows": (trace_windows, WINDOWS_SQL),
    "fit_scale": (fit_scale, FIT_SQL),
    "move_annotations": (move_annotations, MOVE_SQL),
}
