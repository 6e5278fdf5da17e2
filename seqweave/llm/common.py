"""Shared plumbing of the training-data operators.

Everything here is about running safely on many executors: where intermediate tables go, how code reaches the
workers, how rows with hostile schemas are read.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows that are Python objects at once, and their bytes: no more rows than that many of the batch's average size.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where it is unset, and only on a local master, a temporary folder is made and set.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="seqweave-")
        context.setCheckpointDir(folder)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint: survives lost executors, removed with the DataFrame."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder.

    Unlike a checkpoint the reread table is columnar, splittable and claims no partitioning, so a join on it
    shuffles both sides and adaptive execution may split a hot key.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, system = _file_system(spark, path)
    system.deleteOnExit(target)  # with the application, from any store
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file system, so any store works."""
    target, system = _file_system(spark, path)
    system.delete(target, True)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with the package shipped.  A worker gives freed memory back when a task ends, as idle workers stay beside
    the executor's heap."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that Python objects of at most `rows` texts are alive at once, of BATCH_BYTES on average."""
    for b in batches:
        few = max(1, min(rows, BATCH_BYTES * b.num_rows // max(1, b.nbytes)))
        for at in range(0, b.num_rows, few):
            yield b.slice(at, few)


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo parts."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % parts) == part
