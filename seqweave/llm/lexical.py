"""Ranked lexical search over a two-level quantised index, in integers.

Index.  Documents are indexed in segments where they lie, as many-shard search engines do: nothing is shuffled.  A
segment has its terms, each with the documents that hold it.  The first level keeps one byte a posting, the posting's
impact divided by STEP and rounded up; the second the exact number of occurrences, and the documents' lengths.  Columns of
the table are the levels, so what isn't asked for isn't read.

Search.  Queries go to all segments in blocks of bounded size.  In a segment the bytes of a query's terms add up to an upper
bound of each document's score, and, as a byte is at most STEP too high, to a lower bound.  Every document whose upper bound
reaches the k-th lower bound (of this segment, or the k-th score of those before in the task) is scored exactly from the
second level.  Of each task's k best the k best are taken.

Defined results: null and empty texts have no terms and are never found; a null item or one without terms finds nothing;
every row of queries is ranked on its own, repeated ones too; rows of one doc_id are documents of their own; null ids come
last among equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Everything but white space, punctuation and controls of ASCII: letters and digits, and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
UNIT, TF_FACTOR, M_FACTOR = 1_000_000_000, 1000, 8
#: Impacts are below 10 ** 6: so many bytes' steps hold them.
STEP = -(-1_000_000 // 255)
#: A segment ends with so many documents or terms.
SEGMENT_DOCS, SEGMENT_TERMS = 2048, 4 << 20
#: A block of queries that goes to the executors: letters of all texts, and queries whose bounds are summed at once.
BLOCK_LETTERS, SUMMED = 4 << 20, 256

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """In order; ASCII letters are folded and everything between terms is a blank."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def counted(text: str | None) -> Counter:
    return Counter(terms_of(text))


def term_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TERM)).cast("long")


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    n = term_count(F.col(text))
    row = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What an occurrence count is worth in a document of n terms, in exact integers."""
    tf, m = tf.astype(np.int64), 10 + mean_share(n, documents, length)
    if tf.max(initial=0) < (1 << 62) // UNIT:
        return UNIT * tf // (TF_FACTOR * tf + M_FACTOR * m)
    return np.array([UNIT * int(t) // (TF_FACTOR * int(t) + M_FACTOR * int(x)) for t, x in zip(tf, m, strict=True)], np.int64)


def mean_share(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """(90 * n * documents) div length; beyond a long's products in Python's integers."""
    if int(n.max(initial=0)) * 90 * documents < 1 << 62:
        return 90 * n.astype(np.int64) * documents // max(1, length)
    return np.array([90 * int(x) * documents // length for x in n], np.int64)


def index(docs: DataFrame, size: tuple[int, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a segment: ids; terms with starts; ordinals and bytes of the postings; tfs and lengths.

    size: documents and terms of the corpus, as corpus_size has them.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    documents, length = size

    def segment(ids: list[pa.Array], lengths: list[int], known: dict[bytes, int], of: list[np.ndarray], tfs: list[np.ndarray]) -> pa.RecordBatch:
        per = np.array([len(x) for x in of], np.int64)
        term, tf = np.concatenate(of), np.concatenate(tfs)
        ordinal = np.repeat(np.arange(len(of), dtype=np.uint16), per)
        sort = np.argsort(term, kind="stable")  # a term's postings by ordinal
        term, tf, ordinal = term[sort], tf[sort], ordinal[sort]
        starts = np.searchsorted(term, np.arange(len(known) + 1)).astype(np.int32)
        n = np.array(lengths, np.int64)
        byte = -(-impacts(tf, n[ordinal], documents, length) // STEP)
        whole = pa.concat_arrays(ids)
        packed = (b" ".join(known), starts.tobytes(), ordinal.tobytes(), byte.astype(np.uint8).tobytes(), tf.astype(np.int32).tobytes(), n.tobytes())
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole), *(pa.array([p], pa.binary()) for p in packed)]
        return pa.RecordBatch.from_arrays(arrays, ["ids", "terms", "starts", "ordinals", "bytes", "tfs", "lengths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, known, of, tfs, held = [], [], {}, [], [], 0
        for b in common.slices(batches, 256):
            for i, t in enumerate(b.column(1).to_pylist()):
                found = counted(t)
                if not found:
                    continue
                ids.append(b.column(0).slice(i, 1))
                lengths.append(sum(found.values()))
                of.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.int32, len(found)))
                tfs.append(np.fromiter(found.values(), np.int64, len(found)))
                held += len(found)
                if len(ids) == SEGMENT_DOCS or held >= SEGMENT_TERMS:
                    yield segment(ids, lengths, known, of, tfs)
                    ids, lengths, known, of, tfs, held = [], [], {}, [], [], 0
        if ids:
            yield segment(ids, lengths, known, of, tfs)

    schema = f"ids array<{kind}>, terms binary, starts binary, ordinals binary, bytes binary, tfs binary, lengths binary"
    return common.map_batches(docs.select(doc_id, text), run, schema)


def document_counts(segments: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """How many documents hold each of the terms: from the segments' dictionaries alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for i in range(b.num_rows):
                starts = np.frombuffer(b.column("starts")[i].as_py(), np.int32)
                for k, t in enumerate(b.column("terms")[i].as_py().split(b" ")):
                    if t in terms:
                        total[t] += int(starts[k + 1] - starts[k])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    counts = common.map_batches(segments.select("terms", "starts"), run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r.term): r.n for r in counts.collect()}  # no more than the block's terms


def weights(terms: set[bytes], counts: dict[bytes, int], documents: int) -> dict[bytes, int]:
    return {t: int(np.floor(1000 * np.log((2 * documents + 2) / (2 * counts[t] + 1)))) for t in terms if counts.get(t)}


def kth_largest(rows: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k-th largest number, or the least long for shorter rows."""
    if rows.shape[1] < k:
        return np.full(len(rows), np.iinfo(np.int64).min)
    return np.partition(rows, rows.shape[1] - k, 1)[:, rows.shape[1] - k]


class Segment:
    """One row of the index, of which a query reads the postings of its terms."""

    def __init__(self, b: pa.RecordBatch, i: int):
        blob = lambda name, kind: np.frombuffer(b.column(name)[i].as_buffer(), kind)
        self.ids = b.column("ids").slice(i, 1).flatten()
        self.terms = b.column("terms")[i].as_py().split(b" ")
        self.starts, self.ordinals, self.bytes = blob("starts", np.int32), blob("ordinals", np.uint16), blob("bytes", np.uint8)
        self.tfs, self.lengths = blob("tfs", np.int32), blob("lengths", np.int64)

    def holding(self, wanted: dict[bytes, int]) -> dict[bytes, slice]:
        return {t: slice(self.starts[k], self.starts[k + 1]) for k, t in enumerate(self.terms) if t in wanted}

    def bounds(self, queries: list[list[bytes]], weight: dict[bytes, int], held: dict[bytes, slice]) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of the score: a row a query, a column a document."""
        high = np.zeros((len(queries), len(self.lengths)), np.int64)
        mass = np.zeros_like(high)
        for q, terms in enumerate(queries):
            for t in terms:
                if (at := held.get(t)) is not None:
                    high[q, self.ordinals[at]] += weight[t] * self.bytes[at].astype(np.int64)
                    mass[q, self.ordinals[at]] += weight[t]
        high *= STEP
        return high, np.maximum(high - (STEP - 1) * mass, 0)

    def exact(self, terms: list[bytes], weight: dict[bytes, int], held: dict[bytes, slice], rows: np.ndarray, size: tuple[int, int]) -> np.ndarray:
        score = np.zeros(len(rows), np.int64)
        for t in terms:
            if (at := held.get(t)) is not None:
                own = self.ordinals[at]
                place = np.minimum(np.searchsorted(own, rows), len(own) - 1)
                hit = own[place] == rows
                score[hit] += weight[t] * impacts(self.tfs[at][place[hit]], self.lengths[rows[hit]], *size)
        return score


def best_of_segments(segments: DataFrame, queries: list[list[bytes]], weight: dict[bytes, int], size: tuple[int, int], top: int) -> DataFrame:
    """query (its number), doc_id, score: each task's top documents of each query."""
    kind = segments.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        for b in batches:
            for i in range(b.num_rows):
                segment = Segment(b, i)
                held = segment.holding(weight)
                for at in range(0, len(queries), SUMMED):
                    some = queries[at : at + SUMMED]
                    high, low = segment.bounds(some, weight, held)
                    bar = kth_largest(low, top)
                    for q, terms in enumerate(some):
                        own = best[at + q]
                        least = max(int(bar[q]), own[-1][0] if len(own) == top else 1, 1)
                        rows = np.flatnonzero(high[q] >= least)
                        if len(rows):
                            score = segment.exact(terms, weight, held, rows, size)
                            stay = score >= least
                            ids = segment.ids.take(pa.array(rows[stay])).to_pylist()
                            own = own + list(zip(score[stay].tolist(), ids, strict=True))
                            best[at + q] = sorted(own, key=lambda x: (-x[0], x[1] is None, x[1]))[:top]
        rows = [(q, d, s) for q, own in enumerate(best) for s, d in own]
        if rows:
            q, d, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, segment.ids.type), pa.array(s, pa.int64())], ["query", "doc_id", "score"])

    return common.map_batches(segments, run, f"query long, doc_id {kind}, score long")


def blocks(queries: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """Queries in blocks of bounded size, read one partition at a time."""
    held, letters = [], 0
    for r in queries.select(item_id, text).where(F.col(text).isNotNull()).toLocalIterator():
        held.append((r[0], r[1]))
        letters += len(r[1])
        if letters >= BLOCK_LETTERS:
            yield held
            held, letters = [], 0
    if held:
        yield held


def search(segments: DataFrame, queries: DataFrame, size: tuple[int, int], top: int = TOP, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of each query's top documents in an index."""
    spark = segments.sparkSession
    item = queries.schema[item_id].dataType.simpleString()
    kind = segments.schema["ids"].dataType.elementType.simpleString()
    schema = f"item_id {item}, rank int, doc_id {kind}, score long"
    out = None
    for block in blocks(queries, item_id, text):
        terms = [sorted(counted(t)) for _, t in block]
        wanted = {w for t in terms for w in t}
        weight = weights(wanted, document_counts(segments, wanted), size[0])
        found = best_of_segments(segments, terms, weight, size, top)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, b[0]) for i, b in enumerate(block)], f"query long, item_id {item}")
        part = ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # a block's ids
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def rank(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: documents indexed whole, then searched."""
    size = corpus_size(docs)
    return search(common.written(index(docs, size), "lexical-index"), queries, size, top)
