"""WARC archives compressed with Zstandard.

An archive starts with a skippable frame that holds a dictionary; every record follows as one frame.  The writer trains
the dictionary on a bounded sample of pages and writes archives of about ARCHIVE_BYTES, each under a temporary name that
is renamed when complete: a retried task writes the same archives again under the same names.  The reader loads the
dictionary, finds each frame's end from its block headers, decodes one frame at a time and validates version line,
mandatory headers, lengths and digests.

Archives lie in the folder that driver and executors share.  Executors write through Arrow's file systems (local or
mounted folders, and those stores Arrow knows); reading is Spark's.

Defined results: a null html is an empty payload; of equal payloads the row with the smallest page_id is the response
(a null page_id counts as the largest; rows that share the smallest id are all responses) and the others revisit it;
repeated rows are records of their own; an empty table writes no archive and reads as no rows; columns other than
page_id, url and html are ignored; white space and control characters in a url are percent-encoded in its header.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from io import BytesIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ARCHIVE_BYTES = 16 << 20
LEVEL = 3
DICTIONARY_BYTES, SAMPLE_PAGES, SAMPLE_CHARS = 64 << 10, 256, 16 << 10
MIN_REVISIT_BYTES = 0
#: Tasks that read archives back at most.
READ_TASKS = 10_000
DATE = "2024-01-01T00:00:00Z"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")


class WarcError(ValueError):
    """An archive that breaks the format: where, and how."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- records


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One record; a revisit if refers_to is not None."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else "urn:x-page:none"
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[3:3] = [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes, where: str) -> dict[str, str]:
    """Names in lower case; a line that begins with white space goes on from the line before."""
    out: dict[str, str] = {}
    last = ""
    for line in data.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += f" {line.strip()}"
            continue
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"{where}: not a header: {line[:80]!r}")
        last = name.lower()
        out[last] = value.strip()
    return out


def agrees(label: str, data: bytes) -> bool:
    """Whether a digest header fits the data; digests of unknown kinds can't be told and pass."""
    kind, _, value = label.partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5"):
        return True
    raw = hashlib.new(kind.lower(), data).digest()
    return value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=") or value.lower() == raw.hex()


def parse_record(data: bytes, where: str) -> dict:
    """Headers and payload of a record, validated.

    Records of any type are read; only a response or revisit whose block is application/http has an HTTP head before its
    payload, and any other record's block is its payload.
    """
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, _, fields = head.partition(b"\r\n")
    if not blank or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise WarcError(f"{where}: no WARC version line")
    h = headers(fields, where)
    lacking = [m for m in MANDATORY if m not in h]
    if lacking:
        raise WarcError(f"{where}: no {', '.join(lacking)}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError(f"{where}: Content-Length {h['content-length']} but {len(rest) - 4} bytes")
    block = rest[:-4]
    if not agrees(h.get("warc-block-digest", ""), block):
        raise WarcError(f"{where}: block digest differs")
    kind = h["warc-type"]
    if kind == "revisit" and not ("warc-payload-digest" in h and ("warc-refers-to" in h or "warc-refers-to-target-uri" in h)):
        raise WarcError(f"{where}: a revisit without what it refers to")
    payload, length = block, len(block)
    if kind in ("response", "revisit") and h.get("content-type", "").lower().startswith("application/http") and block:
        http, blank, payload = block.partition(b"\r\n\r\n")
        status, _, fields = http.partition(b"\r\n")
        if not status.startswith(b"HTTP/") or not (blank or kind == "revisit"):
            raise WarcError(f"{where}: no HTTP head")
        inner = headers(fields, where) if fields else {}
        stated = inner.get("content-length", "")
        if stated and not stated.isdigit():
            raise WarcError(f"{where}: HTTP Content-Length {stated[:20]!r}")
        length = int(stated) if stated else len(payload)
        if kind == "response" and length != len(payload) and "warc-truncated" not in h:
            raise WarcError(f"{where}: HTTP Content-Length {length} but {len(payload)} bytes")
    if kind != "revisit" and "warc-truncated" not in h and not agrees(h.get("warc-payload-digest", ""), payload):
        raise WarcError(f"{where}: payload digest differs")
    return {"headers": h, "payload": payload, "payload_bytes": length}


# ---- frames


class Source:
    """Reads a stream by numbers of bytes, and knows where it is."""

    def __init__(self, stream, name: str):
        self.stream, self.name, self.at = stream, name, 0

    def take(self, n: int, what: str = "cut off") -> bytes:
        parts = []
        while n > 0:
            data = self.stream.read(n)
            if not data:
                raise WarcError(f"{self.name} at {self.at}: {what}")
            parts.append(data)
            self.at, n = self.at + len(data), n - len(data)
        return b"".join(parts)

    def ended(self) -> bytes | None:
        """None at the end, else the next byte, which is taken."""
        data = self.stream.read(1)
        self.at += len(data)
        return data or None


def next_frame(source: Source, lead: bytes) -> bytes:
    """The Zstandard frame that begins with lead, to its end as its block headers tell."""
    where = f"{source.name} at {source.at - len(lead)}"
    head = lead + source.take(5 - len(lead), "no Zstandard frame")
    if struct.unpack_from("<I", head)[0] != FRAME:
        raise WarcError(f"{where}: no Zstandard frame")
    flags = head[4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    parts = [head, source.take((not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6])]
    last = 0
    while not last:
        block = source.take(3)
        size = block[0] | block[1] << 8 | block[2] << 16
        last = size & 1
        parts += [block, source.take(1 if size >> 1 & 3 == 1 else size >> 3)]
    return b"".join([*parts, source.take(4 * checksum)])


def read_dictionary(source: Source) -> zstandard.ZstdCompressionDict | None:
    """The archive's dictionary: the content of the skippable frame it begins with, which may itself be compressed."""
    magic, size = struct.unpack("<II", source.take(8, "no leading dictionary frame"))
    if magic != SKIPPABLE:
        raise WarcError(f"{source.name}: no leading dictionary frame")
    held = source.take(size, "the dictionary frame is cut off")
    if held[:4] == struct.pack("<I", FRAME):
        held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
    return zstandard.ZstdCompressionDict(held) if held else None


def read_stream(stream, name: str) -> Iterator[tuple[int, dict]]:
    """(offset, record) of each record of an archive, a frame at a time: a record is all that is held."""
    source = Source(stream, name)
    held = read_dictionary(source)
    decompressor = zstandard.ZstdDecompressor(dict_data=held) if held else zstandard.ZstdDecompressor()
    while (lead := source.ended()) is not None:
        at = source.at - 1
        frame = next_frame(source, lead)
        try:
            # Frames of streaming writers don't tell the size of their content.
            plain = decompressor.decompressobj().decompress(frame)
        except zstandard.ZstdError as e:
            raise WarcError(f"{name} at {at}: {e}") from None
        yield at, parse_record(plain, f"{name} at {at}")


def read_archive(content: bytes, name: str) -> Iterator[tuple[int, dict]]:
    """read_stream() of an archive in memory."""
    return read_stream(BytesIO(content), name)


def train(samples: list[bytes]) -> bytes:
    """A dictionary of at most DICTIONARY_BYTES; samples themselves if they are too few to train on."""
    samples = [s for s in samples if s]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


# ---- tables


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html with refers_to: the page whose payload the row repeats, else null."""
    payload = common.text_of("html").cast("binary")
    slim = pages.select("page_id", F.sha1(payload).alias("sha"), F.octet_length(payload).alias("bytes"))
    groups = slim.where(F.col("bytes") >= min_bytes).groupBy("sha", "bytes")
    several = groups.agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    several = common.written(several, "payloads")
    own = pages.select("page_id", "url", "html").withColumns({"sha": F.sha1(payload), "bytes": F.octet_length(payload)})
    joined = own.join(several, ["sha", "bytes"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", F.when(again, F.col("first_id")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row to archives in folder; archive, records of each."""
    # Ids alone are ranked, so what tasks send for the sample does not carry pages.
    ranked = pages.select("page_id").where("page_id IS NOT NULL").orderBy(F.md5(F.col("page_id").cast("string").cast("binary")), "page_id")
    some = pages.join(F.broadcast(ranked.limit(SAMPLE_PAGES).distinct()), "page_id", "left_semi")
    samples = some.select(F.substring(common.text_of("html"), 1, SAMPLE_CHARS).alias("t")).limit(2 * SAMPLE_PAGES).collect()
    dictionary = train([r.t.encode("utf-8", "surrogatepass") for r in samples])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(uri(folder))
        store.create_dir(base, recursive=True)
        attempt = uuid.uuid4().hex[:12]
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=True, write_content_size=True)
        lead = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary
        part, done = TaskContext.get().partitionId(), []
        out, size, n = None, 0, 0

        def close() -> None:
            nonlocal out, size, n
            out.close()
            name = f"part-{part:06d}-{attempt}-{len(done):04d}.warc.zst"
            store.move(f"{base}/{temporary}", f"{base}/{name}")
            done.append((name, n))
            out, size, n = None, 0, 0

        for b in common.slices(batches, 200):
            for page_id, url, html, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    temporary = f"_{uuid.uuid4().hex}.tmp"
                    out = store.open_output_stream(f"{base}/{temporary}", compression=None)
                    out.write(lead)
                frame = compressor.compress(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to))
                out.write(frame)
                size, n = size + len(frame), n + 1
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        names, counts = zip(*done, strict=True) if done else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["archive", "records"])

    return common.map_batches(revisits(pages, min_bytes), run, "archive string, records long")


RECORDS = (
    "archive string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string"
)
_KINDS = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.int64(), pa.string()]


def _rows(records: Iterator[tuple[int, dict]], name: str) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names)

    rows, size = [], 0
    for at, r in records:
        h, payload = r["headers"], r["payload"]
        kind = h["warc-type"]
        sha = h["warc-payload-digest"].removeprefix("sha1:") if kind == "revisit" else digest(payload)
        uris = [h["warc-record-id"], h.get("warc-target-uri"), h.get("warc-refers-to")]
        rows.append((name, at, kind, *(u and u.strip("<>") for u in uris), payload, r["payload_bytes"], sha))
        size += len(payload)
        if size > 8 << 20:
            yield batch(rows)
            rows, size = [], 0
    if rows:
        yield batch(rows)


def read(spark: SparkSession, folder: str, archives: DataFrame | None = None) -> DataFrame:
    """Records of the archives in folder: archive, offset, record_type, record_id, target_uri, refers_to, payload, payload_bytes, payload_digest.

    archives: the names to read, in a column archive, as write() gives them; they are streamed through Arrow's file systems,
    a record at a time.  Without it all archives of the folder are read, by Spark, a whole one at a time.
    """

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(uri(folder))
        for b in batches:
            for name in b.column("archive").to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20) as stream:
                    yield from _rows(read_stream(stream, name), name)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 1):
            name = b.column("path")[0].as_py()
            yield from _rows(read_archive(b.column("content")[0].as_py(), name), name)

    if archives is not None:
        return common.map_batches(archives.select("archive"), streamed, RECORDS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return common.map_batches(files, whole, RECORDS)


def uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: every row written to archives and read back."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    folder = f"{common.shared_dir(spark)}/seqweave/warc-{uuid.uuid4().hex}"
    done = common.written(write(pages, folder), "archives")  # what lost attempts have left is not among them
    n = done.count()
    if not n:
        rows = spark.createDataFrame([], f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")
        return rows

    def page(uri: str):
        return F.expr(f"try_cast(nullif(regexp_replace({uri}, '^urn:x-page:', ''), 'null') AS {kind})")

    rows = read(spark, folder, done.repartition(min(n, READ_TASKS))).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )
    rows = common.written(rows, "records")
    common.discard(spark, folder)
    return rows
