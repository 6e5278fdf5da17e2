"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are compared with references of its
language by the Jensen-Shannon distance (base 2, 0 to 1).  The references come from all documents of the language: the
median share of each character class, which junk moves little, and the summed counts of the COMMON most frequent words,
with "any other word" as one more bin.  A document too short for a histogram to mean anything is not judged by it
(MIN_CHARS, MIN_WORDS), and the allowed distance shrinks with the square root of the length, as sampling noise does.

The base rules need no reference: too few words, or too many words inside repeated windows of WINDOW words.

Defined results: a null text counts as empty and fails the base rules; a null lang is a language of its own; a language
with fewer than MIN_DOCS documents of MIN_CHARS characters is compared with the reference of all documents; repeated rows are judged alike; an
empty table gives no rows; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 8
COMMON = 60
MIN_CHARS, MIN_WORDS, MIN_DOCS = 100, 200, 20
#: Allowed distance: first number, plus second over the square root of the characters or words.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = (0.10, 3.6), (0.27, 1.4)
#: Shares of a class are counted in bins of their square root.
BINS = 1000
SYMBOLS = b"#*$%&|<>"
#: Distinct words, and languages' tables, that are counted before they leave the worker.
FLUSH, TABLES = 100_000, 128

CLASSES = ("lower", "upper", "digit", "space", "line end", "stop", "comma", "symbol", "bar", "mark", "other", "beyond ASCII")


def _class_of_byte() -> np.ndarray:
    """Class of each UTF-8 byte; -1 for bytes that continue a character."""
    out = np.full(256, 10)
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = 0, 1, 2
    for k, chars in ((3, b" \t"), (4, b"\n\r\x0b\x0c"), (5, b"."), (6, b","), (7, b"#*$%&<>@^~=_+\\/"), (8, b"|"), (9, b"!?")):
        out[list(chars)] = k
    out[0x80:0xC0], out[0xC0:] = -1, 11
    return out


CLASS_OF_BYTE = _class_of_byte()
_BY_CLASS = np.array([CLASS_OF_BYTE == k for k in range(len(CLASSES))]).T.astype(np.int64)


def classes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Counts of bytes, and of characters by class."""
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return by_byte, by_byte @ _BY_CLASS


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more, the first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    ids_of: dict[bytes, int] = {}
    ids = np.fromiter((ids_of.setdefault(w, len(ids_of)) for w in words), np.int64, n)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    m = n - window + 1
    h = np.zeros(m, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x94D049BB133111EB) + mixed[k : k + m]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(m, bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    at = np.nonzero(maybe)[0]
    # The hashes only propose; the windows themselves are compared.
    _, back, count = np.unique(ids[at[:, None] + np.arange(window)], axis=0, return_inverse=True, return_counts=True)
    at = at[count[back.ravel()] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def base(text: str | None) -> tuple[tuple[int, int, int, int, int], list[bytes], np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), the words, characters by class."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    by_byte, by_class = classes(data)
    white = int(by_byte[9:14].sum() + by_byte[32])
    chars = int(by_class.sum())
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    return (len(words), chars - white, int(by_byte[list(SYMBOLS)].sum()), dup, repeated_words(words)), words, by_class


def histograms(docs: DataFrame) -> DataFrame:
    """lang, kind (class or word), class, key, n: documents by class and bin, and counts of lower-case words.  Over all documents.

    Counts leave a worker after FLUSH distinct words or languages' tables of the same size, in small batches, and are
    summed by Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str | None, Counter] = {}
        bins: dict[str | None, np.ndarray] = {}

        def rows() -> Iterator[tuple]:
            for lang, held in words.items():
                yield from ((lang, None, w, n) for w, n in held.items())
            for lang, table in bins.items():
                for k, at in zip(*(x.tolist() for x in np.nonzero(table)), strict=True):
                    yield lang, k, str(at).encode(), int(table[k, at])

        def flush() -> Iterator[pa.RecordBatch]:
            every = rows()
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.int64())
            while some := list(islice(every, 20_000)):
                cols = zip(zip(*some, strict=True), kinds, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in cols], ["lang", "class", "key", "n"])
            words.clear()
            bins.clear()

        for b in common.slices(batches, 500):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                words.setdefault(lang, Counter()).update(data.lower().split())
                by_class = classes(data)[1]
                if by_class.sum() >= MIN_CHARS:
                    table = bins.get(lang)
                    if table is None:
                        table = bins[lang] = np.zeros((len(CLASSES), BINS + 1), np.int32)
                    table[np.arange(len(CLASSES)), np.rint(np.sqrt(by_class / by_class.sum()) * BINS).astype(np.int64)] += 1
                if len(bins) > TABLES:
                    yield from flush()
            if sum(map(len, words.values())) > FLUSH:
                yield from flush()
        yield from flush()

    rows = common.map_batches(docs.select("text", "lang"), run, "lang string, class int, key binary, n long")
    return common.written(rows.groupBy("lang", "class", "key").agg(F.sum("n").alias("n")), "histograms")


def summarised(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by, class, middle, docs; by, key, n, n_words): the median bin of each class, and the COMMON most frequent words."""
    bins = rows.where("class IS NOT NULL").withColumn("at", F.col("key").cast("string").cast("int"))
    bins = bins.groupBy(*by, "class", "at").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*by, "class").orderBy("at")  # BINS + 1 rows at most
    below = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    half = bins.withColumn("below", below).withColumn("docs", total).where(2 * F.col("below") >= F.col("docs"))
    middle = half.groupBy(*by, "class").agg(F.min("at").alias("middle"), F.first("docs").alias("docs"))
    words = rows.where("class IS NULL").groupBy(*by, "key").agg(F.sum("n").alias("n"))
    totals = words.groupBy(*by).agg(F.sum("n").alias("n_words"))
    # COMMON candidates from each of 64 parts, then COMMON of those.
    part = words.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(64)))
    for group in ([*by, "part"], by):
        best = Window.partitionBy(*group).orderBy(F.desc("n"), "key")
        part = part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= COMMON)
    top = part.select(*by, "key", "n")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    joined = top.alias("t").join(totals.alias("s"), same)
    return middle, joined.select(*[f"t.{c}" for c in by], "key", "n", "n_words")


def references(docs: DataFrame) -> dict:
    """Distributions to compare with, over all documents: by language, of those with MIN_DOCS documents, and of the whole."""
    rows = histograms(docs)

    def shares(middle: dict[int, int], words: list[tuple[bytes, int]], n_words: int) -> tuple[np.ndarray, dict[bytes, int], np.ndarray]:
        usual = (np.array([middle.get(k, 0) for k in range(len(CLASSES))]) / BINS) ** 2
        words = sorted(words, key=lambda w: (-w[1], w[0]))
        counts = np.array([n for _, n in words] + [n_words - sum(n for _, n in words)], float)
        return usual / max(1e-9, usual.sum()), {w: i for i, (w, _) in enumerate(words)}, counts / max(1, counts.sum())

    def collected(rows: DataFrame, least: int) -> dict[str | None, tuple]:
        """By lang, with enough documents: len(CLASSES) and COMMON rows of each."""
        middle, words = summarised(rows, ["lang"])
        middle = middle.where(F.col("docs") >= least)
        held: dict[str | None, tuple[dict, list, list]] = {}
        for r in middle.toLocalIterator():
            held.setdefault(r.lang, ({}, [], [0]))[0][r["class"]] = r.middle
        if least:
            known = middle.where(F.col("class") == 0).select(F.col("lang").alias("known"))
            words = words.join(known, F.col("lang").eqNullSafe(F.col("known")), "left_semi")
        for r in words.toLocalIterator():
            x = held.setdefault(r.lang, ({}, [], [0]))
            x[1].append((bytes(r.key), r.n))
            x[2][0] = r.n_words
        return {k: shares(m, w, n[0]) for k, (m, w, n) in held.items()}

    whole = collected(rows.withColumn("lang", F.lit("")), 0).get("") or shares({}, [], 0)
    return {"whole": whole, "by": collected(rows, MIN_DOCS)}


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2."""
    m = (p + q) / 2

    def part(x: np.ndarray) -> float:
        held = x > 0
        return float((x[held] * np.log2(x[held] / m[held])).sum())

    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def allowed(distance: float | None, limits: tuple[float, float], size: int) -> bool:
    return distance is None or bool(distance <= limits[0] + limits[1] / size**0.5)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, class_distance, word_distance (null where not judged), kept."""
    docs = docs.select("doc_id", "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(references(docs))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, by = shared.value["whole"], shared.value["by"]
        for b in common.slices(batches, 500):
            rows = []
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                counts, words, by_class = base(text)
                failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
                class_shares, known, word_shares = by.get(lang, whole)
                d_class = d_word = None
                if by_class.sum() >= MIN_CHARS:
                    d_class = distance(by_class / by_class.sum(), class_shares)
                if len(words) >= MIN_WORDS:
                    got = np.zeros(len(word_shares))
                    for w, n in Counter(words).items():
                        got[known.get(w.lower(), -1)] += n
                    d_word = distance(got / got.sum(), word_shares)
                kept = not failed and allowed(d_class, MAX_CLASS_DISTANCE, by_class.sum()) and allowed(d_word, MAX_WORD_DISTANCE, len(words))
                rows.append((*counts, failed, d_class, d_word, kept))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            out = [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", *names, "base_failed", "class_distance", "word_distance", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{n} long" for n in names)
    schema = f"doc_id {kind}, {counts}, base_failed boolean, class_distance double, word_distance double, kept boolean"
    return common.map_batches(docs, run, schema)
