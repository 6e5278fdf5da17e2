"""Record files read in byte ranges: a Python data source, so that one file of any size is many tasks' work.

A split owns the records whose mark (a line that starts with LOCUS, or with >) begins in its bytes, and reads on to the end of
the last of them.  Every record is so read once, wherever the ranges are cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shipping import ship

#: What the line that begins a record starts with.
MARKS = {"genbank": b"LOCUS", "fasta": b">"}
SPLIT_BYTES, CHUNK = 32 << 20, 1 << 20


@dataclass
class Split(InputPartition):
    path: str
    begin: int
    end: int


def _opened(path: str):
    """(file system, path in it): of any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(folder: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files below a folder, hidden ones passed over."""
    from pyarrow import fs

    system, root = _opened(folder)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(folder, info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    shown = lambda p: not any(x.startswith((".", "_")) for x in p[len(root) :].split("/"))
    lead = folder.rstrip("/")
    kept = [f for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffixes) and shown(f.path)]
    return sorted((lead + f.path[len(root.rstrip("/")) :], f.size) for f in kept)


def marks_in(stream, mark: bytes, begin: int, end: int) -> Iterator[int]:
    """Offsets from begin to before end at which a line starts with the mark."""
    at, tail = max(0, begin - 1), b""
    stream.seek(at)
    if at == 0:
        tail, at = b"\n", -1  # as if a line had ended before the file
    while at < end + len(mark):
        held = tail + stream.read(CHUNK)
        if len(held) <= len(tail):
            return
        k = held.find(b"\n" + mark)
        while k >= 0:
            if at + k + 1 >= end:
                return
            if at + k + 1 >= begin:
                yield at + k + 1
            k = held.find(b"\n" + mark, k + 1)
        keep = min(len(held), len(mark))
        at, tail = at + len(held) - keep, held[len(held) - keep :]


def records(stream, mark: bytes, begin: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records that begin in a range; one record is held at a time."""
    for at in list(marks_in(stream, mark, begin, end)):
        following = next(marks_in(stream, mark, at + 1, size), size)
        stream.seek(at)
        yield at, stream.read(following - at)


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind = options.get("kind", "genbank")
        self.path = options["path"]
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.suffixes = tuple(x.strip().lower() for x in options.get("suffixes", ".gb,.gbk" if self.kind == "genbank" else ".fa,.fasta,.faa").split(","))
        if self.kind not in MARKS or self.split < 1:
            raise ValueError(f"kind is one of {sorted(MARKS)}, splitBytes at least 1")

    def partitions(self) -> list[Split]:
        found = [Split(p, at, min(n, at + self.split)) for p, n in listed(self.path, self.suffixes) for at in range(0, n, self.split)]
        return found or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[tuple]:
        if not partition.path:
            return
        system, path = _opened(partition.path)
        with system.open_input_file(path) as stream:
            for at, body in records(stream, MARKS[self.kind], partition.begin, partition.end, stream.size()):
                yield partition.path, at, body.decode("utf-8", "replace")


class RecordSource(DataSource):
    """spark.read.format("sequence_records").option("kind", "genbank" or "fasta").load(path): path, at (byte offset), text of each record."""

    @classmethod
    def name(cls) -> str:
        return "sequence_records"

    def schema(self) -> str:
        return "path string, at long, text string"

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options))


def read_records(spark: SparkSession, path: str, kind: str = "genbank", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, at, text of each record of the files at a path, in splits of about split_bytes."""
    ship(spark)
    spark.dataSource.register(RecordSource)
    return spark.read.format("sequence_records").option("kind", kind).option("splitBytes", str(split_bytes)).load(path)


