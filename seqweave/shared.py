"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """(path, its file system) as Spark's own file systems see it, so any store works."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir that goes with the application; only a local master may leave that unset."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="seqweave-")
        context.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/seqweave/{name}-{uuid.uuid4().hex}"
    target, system = file_system(spark, path)
    system.mkdirs(target)
    system.deleteOnExit(target)
    return path
