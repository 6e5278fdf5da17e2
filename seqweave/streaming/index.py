"""A k-mer index of the files of a folder, kept on disk: follows the folder, and searches without reading the texts again.

Layout below the index's folder, for each generation g:
  g/texts/commit=n          path, mtime, size, gone, sequence of the files that the commit read or found gone
  g/kmers/commit=n/lead=x   path, at, kmer, before, after: those texts cut end to end into k-mers, each with the letters beside it,
                            sorted by k-mer in each file; x is the k-mer's first LEAD letters
  g/commits                 the commits that count, with the stream and batch that they took in
A commit counts once its row is there, which is written last: a job that dies leaves nothing that is read, and the next one
overwrites its folders.  A batch that a stream repeats is known by its number and not written twice.  A file's latest commit
holds its state.  compact() writes what is live as a new generation; readers move when that is whole.  One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import both_strands, occurrences
from ..operators.tables import CHUNK, chunked, small
from ..shared import file_system
from ..sources.formats import origin_bases, text_of

K, LEAD = 12, 3
#: Changed files that a refresh reads as one commit; their paths pass through the driver, as Spark's own listing does.
FILES = 10_000
PATTERN = "*.{gb,gbk}"
TEXTS = "path string, mtime timestamp, size long, gone boolean, sequence string"
KMERS = "path string, at long, kmer string, before string, after string"
#: Letters on each side of a k-mer that are kept with it: a probe's ends are compared with them.
BESIDE = K - 1
COMMITS = "number int, stream string, batch long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at a path, empty if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _home(spark: SparkSession, index: str) -> str:
    """The folder of the latest whole generation."""
    last = _read(spark, f"{index}/generations", "generation int").agg(F.max("generation")).first()[0] or 0
    return f"{index}/{last}"


def lead(kmer: Column) -> Column:
    """The partition of a k-mer: its first letters, with N for all but A, C, G and T, so there are 155 at most."""
    return F.regexp_replace(F.upper(F.substr(kmer, F.lit(1), F.lit(LEAD))), "[^ACGT]", "N")


def _entries(texts: DataFrame) -> DataFrame:
    """path, at, kmer, before, after, lead of the texts' k-mers, end to end; the last one has what is left of the text."""
    pieces = chunked(texts.select("path", "sequence"), "sequence", BESIDE, K + BESIDE, CHUNK // K * K)
    first = F.col("chunk_at") - F.col("chunk_base")
    own = F.sequence(first, F.least(F.length("chunk") - 1, first + CHUNK // K * K - 1), F.lit(K))
    rows = pieces.select("path", "chunk", "chunk_base", F.explode(own).alias("i"))
    cut = lambda at, n: F.substr(F.col("chunk"), at + 1, n)
    held = F.least(F.col("i"), F.lit(BESIDE))
    rows = rows.select(
        "path", (F.col("chunk_base") + F.col("i")).cast("long").alias("at"), cut(F.col("i"), F.lit(K)).alias("kmer"),
        cut(F.col("i") - held, held).alias("before"), cut(F.col("i") + K, F.lit(BESIDE)).alias("after"),
    )
    return rows.withColumn("lead", lead(F.col("kmer")))


def _save(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def upsert(rows: DataFrame, index: str, stream: str | None = None, batch: int | None = None) -> bool:
    """Takes rows (path, mtime, size, sequence, one a path) in as one commit; a null sequence says that the file is gone.

    stream, batch: a batch that is already in, or one before it, is passed over, and False is returned.
    """
    spark = rows.sparkSession
    home = _home(spark, index)
    commits = _read(spark, f"{home}/commits", COMMITS)
    last, seen = commits.agg(F.max("number"), F.max(F.when(F.col("stream") == F.lit(stream), F.col("batch")))).first()
    if stream is not None and seen is not None and batch <= seen:
        return False
    number = (last or 0) + 1
    texts = f"{home}/texts/commit={number}"
    kept = rows.select("path", "mtime", F.col("size").cast("long").alias("size"), F.col("sequence").isNull().alias("gone"), "sequence")
    _save(kept, texts)
    # From what was written: a file that changes meanwhile can't make the texts and the k-mers differ.
    # Sorted where they are cut, without a shuffle; compact() ranges them.
    entries = _entries(spark.read.schema(TEXTS).parquet(texts))
    _save(entries.sortWithinPartitions("lead", "kmer", "path", "at"), f"{home}/kmers/commit={number}", "lead")
    _mark(spark, home, [(number, stream, batch)])
    return True


def _mark(spark: SparkSession, home: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, COMMITS).coalesce(1).write.mode("append").parquet(f"{home}/commits")


def live(spark: SparkSession, index: str) -> DataFrame:
    """path, mtime, size, commit of the files that are in the index; reads no texts."""
    home = _home(spark, index)
    good = _read(spark, f"{home}/commits", COMMITS).select(F.col("number").alias("commit")).distinct()
    rows = _read(spark, f"{home}/texts", f"{TEXTS}, commit int").select("path", "mtime", "size", "gone", "commit").join(F.broadcast(good), "commit")
    last = rows.groupBy("path").agg(F.max(F.struct("commit", "mtime", "size", "gone")).alias("r")).where(~F.col("r.gone"))
    return last.select("path", "r.mtime", "r.size", "r.commit")


def current(spark: SparkSession, index: str) -> DataFrame:
    """path, mtime, size, sequence: the latest state of each file."""
    texts = _read(spark, f"{_home(spark, index)}/texts", f"{TEXTS}, commit int").select("path", "commit", "sequence")
    return live(spark, index).join(texts, ["path", "commit"]).select("path", "mtime", "size", "sequence")


def _files(spark: SparkSession, pattern: str):
    reader = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")


def _rows(files: DataFrame) -> DataFrame:
    bases = F.coalesce(origin_bases(text_of("content")), F.lit(""))
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), bases.alias("sequence"))


def watch(spark: SparkSession, folder: str, index: str, checkpoint: str, pattern: str = PATTERN, once: bool = True) -> StreamingQuery:
    """Starts a query that takes new files in as they appear.  once: ends when all that are there now are in; else it goes on.

    A stream of files sees each path once; refresh() finds those that changed and those that are gone.
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = stream.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    writer = _rows(files).writeStream.foreachBatch(lambda batch, number: upsert(batch, index, checkpoint, number) and None)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def _blocks(paths: Iterator[str], size: int) -> Iterator[list[str]]:
    while block := list(islice(paths, size)):
        yield block


def refresh(spark: SparkSession, folder: str, index: str, pattern: str = PATTERN, files: int = FILES) -> dict[str, int]:
    """Brings the index to the folder's present state: the numbers of files read, reused and gone.

    A file is read if its path is new or its time or size differ; the rest isn't opened.
    """
    listing = _rows(_files(spark, pattern).load(folder)).select("path", "mtime", "size")
    state = live(spark, index).select("path", "mtime", "size").persist()
    try:
        reused = listing.join(state, ["path", "mtime", "size"], "left_semi").count()
        gone = state.join(listing, "path", "left_anti")
        lost = gone.count()
        changed = listing.join(state, ["path", "mtime", "size"], "left_anti").select("path")
        read = 0
        for block in _blocks((r.path for r in changed.toLocalIterator()), files):
            upsert(_rows(_files(spark, pattern).load([_literal(p) for p in block])), index)
            read += len(block)
        if lost:
            upsert(gone.withColumn("sequence", F.lit(None).cast("string")), index)
    finally:
        state.unpersist()
    return {"read": read, "reused": reused, "gone": lost}


def _literal(path: str) -> str:
    """A path with the signs that a pattern gives a meaning escaped."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in path)


def compact(spark: SparkSession, index: str) -> None:
    """Writes what is live as a new generation with one commit; older ones are no longer read, and vacuum() deletes them."""
    old = _home(spark, index)
    number = int(old.rsplit("/", 1)[1]) + 1
    new = f"{index}/{number}"
    state = live(spark, index).select("path", "commit")
    _save(current(spark, index).select("path", "mtime", "size", F.lit(False).alias("gone"), "sequence"), f"{new}/texts/commit=0")
    rows = _read(spark, f"{old}/kmers", f"{KMERS}, commit int, lead string").join(state, ["path", "commit"], "left_semi").drop("commit")
    # Ranges by place too, so that a k-mer that is everywhere is many tasks' work.
    ranged = rows.repartitionByRange("lead", "kmer", "path", "at").sortWithinPartitions("lead", "kmer", "path", "at")
    _save(ranged, f"{new}/kmers/commit=0", "lead")
    seen = _read(spark, f"{old}/commits", COMMITS).where("stream IS NOT NULL").groupBy("stream").agg(F.max("batch").alias("batch"))
    marks = seen.select(F.lit(0).alias("number"), "stream", "batch").union(spark.createDataFrame([(0, None, None)], COMMITS))
    marks.coalesce(1).write.mode("overwrite").parquet(f"{new}/commits")
    spark.createDataFrame([(number,)], "generation int").coalesce(1).write.mode("append").parquet(f"{index}/generations")


def vacuum(spark: SparkSession, index: str) -> None:
    """Deletes the generations before the latest; no search of theirs may still run."""
    for number in range(int(_home(spark, index).rsplit("/", 1)[1])):
        target, system = file_system(spark, f"{index}/{number}")
        system.delete(target, True)


def tiles(probes: DataFrame) -> DataFrame:
    """probes (probe, of K letters at least) with n_tiles, off, kmer, lead: k-mers end to end, the last one flush with the probe's end."""
    n = F.length("probe")
    ends = F.array_distinct(F.concat(F.sequence(F.lit(0), n - K, F.lit(K)), F.array(n - K)))
    rows = probes.withColumn("_off", ends).select("*", F.size("_off").alias("n_tiles"), F.explode("_off").alias("off")).drop("_off")
    rows = rows.withColumn("kmer", F.substr(F.col("probe"), F.col("off") + 1, F.lit(K)))
    return rows.withColumn("lead", lead(F.col("kmer")))


def _kmers(spark: SparkSession, index: str, wanted: DataFrame) -> DataFrame:
    """The index's rows in the partitions that wanted's leads name: they are collected, 155 at most."""
    rows = _read(spark, f"{_home(spark, index)}/kmers", f"{KMERS}, commit int, lead string")
    return rows.where(F.col("lead").isin([r[0] for r in wanted.select("lead").distinct().collect()]))


def search(spark: SparkSession, index: str, queries: DataFrame) -> DataFrame:
    """query_id, path, start, end, strand of every exact occurrence of the queries (query_id, sequence) on both strands.

    A text's k-mers lie end to end, so an occurrence may begin at each of K phases before the first whole k-mer in it.  The
    probe occurs where all k-mers of a phase do, one behind the other, with the probe's ends beside the first and the last:
    no text is read, and of the index only the partitions of those k-mers.  Where a phase has no whole k-mer, as in probes
    below 2 * K - 1 letters, the occurrence lies in the k-mer in which it begins and the letters behind it; all partitions are
    read for those.  Probes are a table's side of the join, broadcast only if they are counted to be few.  Null and empty
    queries have no hits; equal rows count once.
    """
    probes = both_strands(queries.select("query_id", "sequence").distinct()).select("query_id", "strand", F.col("probe").alias("whole")).where(F.length("probe") > 0)
    n, key = F.length("whole"), F.sha2("whole", 256).alias("key")
    phased = probes.select("*", F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("phase"))
    inner = (F.floor((n - F.col("phase")) / K) * K).cast("int")
    long = tiles(phased.where(inner >= K).withColumn("probe", F.substr(F.col("whole"), F.col("phase") + 1, inner)))
    ends = F.col("phase") + F.col("off") + K
    left = F.when(F.col("off") == 0, F.substr(F.col("whole"), F.lit(1), F.col("phase"))).otherwise("")
    right = F.when(F.col("off") == F.length("probe") - K, F.substr(F.col("whole"), ends + 1)).otherwise("")
    long = long.select("query_id", "strand", n.alias("n"), key, "phase", "n_tiles", "off", "kmer", "lead", left.alias("left"), right.alias("right"))
    met = _kmers(spark, index, long).join(small(long), ["lead", "kmer"]).where(F.endswith("before", "left") & F.startswith("after", "right"))
    start = (F.col("at") - F.col("off") - F.col("phase")).alias("start")
    whole = met.groupBy("query_id", "strand", "key", "n", "phase", "n_tiles", "path", "commit", start).count()
    hits = whole.where("count = n_tiles").select("query_id", "strand", "n", "path", "commit", "start")
    short = probes.where(n < 2 * K - 1).select("query_id", "strand", n.alias("n"), "whole")
    entries = _read(spark, f"{_home(spark, index)}/kmers", f"{KMERS}, commit int, lead string")
    entries = entries.select("path", "commit", F.col("at").alias("tile"), F.length("kmer").alias("own"), F.concat("kmer", "after").alias("text"))
    found = occurrences(entries, "text", short, "whole").where("at < own")
    # Phases with a whole k-mer are above: of K letters and more, what begins in a k-mer and has none behind it whole is left.
    found = found.where((F.col("n") < K) | ((F.col("at") > 0) & (F.col("at") + F.col("n") < 2 * K)))
    hits = hits.union(found.select("query_id", "strand", "n", "path", "commit", (F.col("tile") + F.col("at")).alias("start")))
    hits = hits.join(live(spark, index).select("path", "commit"), ["path", "commit"])
    return hits.select("query_id", "path", "start", (F.col("start") + F.col("n") - 1).alias("end"), "strand")
