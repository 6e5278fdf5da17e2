"""An inventory read from one spreadsheet or delimited file, with a status instead of an exception.

status: 'disabled' (no file given), 'missing' (can't be read), 'error' (read, but no inventory), 'ok'.
"""

from __future__ import annotations

import zipfile
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import parse_delimited, read_sheet

SCHEMA = "row_no long, name string, sequence string, extra map<string, string>"


@dataclass
class Inventory:
    status: str
    message: str | None = None
    headers: list[str] = field(default_factory=list)
    extra_columns: list[str] = field(default_factory=list)
    entries: DataFrame | None = None


def resolve_column(headers: list[str], wanted: str | None, fallback: int, label: str) -> int:
    """Place of a needed column: as named, or whatever its case; by place if no name is given.  An error lists the headers."""
    if not wanted:
        if fallback < len(headers):
            return fallback
        raise ValueError(f"no column {fallback + 1} for the {label}; there are {' | '.join(headers)}")
    at = optional_column(headers, wanted, None)
    if at < 0:
        raise ValueError(f'{label} column "{wanted}" not found; there are {" | ".join(headers)}')
    return at


def optional_column(headers: list[str], wanted: str | None, usual: str | None) -> int:
    """Place of a column that may be absent, -1 then; never an error."""
    name = wanted or usual
    if not name:
        return -1
    if name in headers:
        return headers.index(name)
    return next((i for i, h in enumerate(headers) if h.lower() == name.lower()), -1)


def entries_of(rows: list[list[str]], name_column: str | None = None, sequence_column: str | None = None) -> tuple[list[str], list[str], list[tuple]]:
    """(headers, extra columns, entries) of a sheet's rows; rows without a sequence are passed over."""
    if not rows:
        raise ValueError("the inventory file has no rows")
    headers = [h.strip() for h in rows[0]]
    name, seq = resolve_column(headers, name_column, 0, "name"), resolve_column(headers, sequence_column, 1, "sequence")
    extra = {h: i for i, h in reversed(list(enumerate(headers))) if h and i not in (name, seq)}
    extra = dict(sorted(extra.items(), key=lambda x: x[1]))
    out = []
    for n, row in enumerate(rows[1:], 1):
        def cell(i: int, row: list[str] = row) -> str:
            return row[i].strip() if i < len(row) else ""

        if cell(seq):
            out.append((n, cell(name), cell(seq), {h: cell(i) for h, i in extra.items()}))
    return headers, list(extra), out


def load(spark: SparkSession, path: str | None, name_column: str | None = None, sequence_column: str | None = None, sheet: str | None = None) -> Inventory:
    if not path:
        return Inventory("disabled")
    file = path.rsplit("/", 1)[-1]
    if file.startswith("~$"):
        return Inventory("error", f'"{file}" is a lock file, not a workbook')
    try:
        found = spark.read.format("binaryFile").load(path).select("content").first()
    except PySparkException as e:
        return Inventory("missing", f"cannot read {path}: {str(e).splitlines()[0]}")
    if found is None:  # Spark lists no empty files
        return Inventory("error", "the inventory file has no rows")
    ext = file.rpartition(".")[2].lower()
    try:
        if ext in ("csv", "tsv", "txt"):
            rows = parse_delimited(bytes(found.content).decode("utf-8"))
        elif ext in ("xlsx", "xlsm"):
            rows = read_sheet(bytes(found.content), sheet)
        else:
            return Inventory("error", f'unsupported inventory file type ".{ext}"')
        headers, extra, entries = entries_of(rows, name_column, sequence_column)
    except (ValueError, zipfile.BadZipFile) as e:
        return Inventory("error", str(e))
    return Inventory("ok", None, headers, extra, spark.createDataFrame(entries, SCHEMA))


class Loader:
    """load() that reads a file again only if its time or size changed, or other columns or another sheet are asked for.

    A parsed file is kept whether it held an inventory or not, as its text decides that; a file that can't be found is looked
    for each time.  The last `most` are kept.  Spark's listing gives time and size; no content is opened for them.
    """

    def __init__(self, spark: SparkSession, most: int = 16):
        self.spark, self.most, self.read = spark, most, 0
        self._kept: OrderedDict[tuple, Inventory] = OrderedDict()

    def load(self, path: str | None, name_column: str | None = None, sequence_column: str | None = None, sheet: str | None = None) -> Inventory:
        stamp = self._stamp(path) if path else None
        asked = (path, name_column, sequence_column, sheet)
        if stamp is not None and (asked, stamp) in self._kept:
            self._kept.move_to_end((asked, stamp))
            return self._kept[asked, stamp]
        self.read += 1
        found = load(self.spark, path, name_column, sequence_column, sheet)
        if stamp is not None and found.status in ("ok", "error"):
            for old in [k for k in self._kept if k[0] == asked]:
                del self._kept[old]
            self._kept[asked, stamp] = found
            while len(self._kept) > self.most:
                self._kept.popitem(last=False)
        return found

    def _stamp(self, path: str) -> tuple | None:
        try:
            row = self.spark.read.format("binaryFile").load(path).select("modificationTime", "length").first()
        except PySparkException:
            return None
        return tuple(row) if row else None


def capped_reads(reads: DataFrame, name: str = "name", most: int = 50) -> tuple[DataFrame, int]:
    """The first `most` reads in natural order of their names, and how many were left out."""
    from ..functions.sequences import natural_key

    return reads.orderBy(natural_key(name), name).limit(most), max(0, reads.agg(F.count(F.lit(1))).first()[0] - most)
