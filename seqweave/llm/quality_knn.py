"""Quality classifier: nearest-neighbour voting in a latent semantic space.

Terms.  A text's words are hashed to WORDS term buckets; next to them stand terms for each word's shape (runs of lower,
upper, digit, and the other characters as they are), for words that repeat a word just before, and for repeated lines.
Weights are the square root of a term's share times its inverse document frequency over all documents.

Space.  Labelled documents, balanced between classes, span a latent space by singular value decomposition; the space
and their vectors are broadcast.  Every document is projected and compared with all labelled vectors by exact products,
a block of documents at a time; the NEIGHBOURS nearest vote with their labels, weighted by a power of the cosine.

Bound of the training sample, the only sampling: SAMPLE documents a class.  Its vectors have a fixed size: at most
2 * SAMPLE * AXES numbers.

Defined results: null and empty texts have no vector and get the share of label 1 in the sample; rows without a label or
with a null label are not learned from; if no class has labels, scores are 0; repeated rows score alike; labels
are averaged if a doc_id has several; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .toxicity import sample_ids

WORDS, SHAPES, EVENTS = 768, 254, 2
TERMS = WORDS + SHAPES + EVENTS
#: Shape and event terms count this much more than words.
SHAPE_WEIGHT = 3.0
AXES = 48
SAMPLE = 2500
NEIGHBOURS = 25
POWER = 8
THRESHOLD = 0.3
MEMO = 200_000
BLOCK = 512


def shape(word: str) -> str:
    out = []
    for c in word:
        k = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:8])


class Terms:
    """Term counts of texts, with a bounded memo of words."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.bucket = np.zeros(1024, np.int32)
        self.shape = np.zeros(1024, np.int32)

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.ids]
        at = len(self.ids)
        if at + len(fresh) > len(self.bucket):
            grow = max(len(fresh), len(self.bucket))
            self.bucket = np.concatenate([self.bucket, np.zeros(grow, np.int32)])
            self.shape = np.concatenate([self.shape, np.zeros(grow, np.int32)])
        digest = xxhash.xxh32_intdigest
        for k, w in enumerate(fresh, at):
            self.ids[w] = k
            self.bucket[k] = digest(w.lower().encode("utf-8", "surrogatepass"), 1) % WORDS
            self.shape[k] = WORDS + digest(shape(w).encode("utf-8", "surrogatepass"), 2) % SHAPES

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """[text, term]."""
        lists = [(t or "").split() for t in texts]
        if len(self.ids) > MEMO:
            self.clear()
        self.learn(set().union(*lists) if lists else set())
        out = np.zeros((len(texts), TERMS), np.float32)
        get = self.ids.__getitem__
        for i, words in enumerate(lists):
            if not words:
                continue
            ids = np.fromiter(map(get, words), np.int64, len(words))
            out[i] = np.bincount(self.bucket[ids], minlength=TERMS) + np.bincount(self.shape[ids], minlength=TERMS)
            near = np.zeros(len(ids), bool)
            for back in (1, 2, 3):
                near[back:] |= ids[back:] == ids[:-back]
            lines = [x for x in texts[i].split("\n") if x.strip()]
            out[i, WORDS + SHAPES] = near.sum()
            out[i, WORDS + SHAPES + 1] = (len(lines) - len(set(lines))) * len(words) / max(1, len(lines))
        return out


_terms = Terms()


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and the number of documents with a word: over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(TERMS, np.int64), 0
        for b in common.slices(batches, BLOCK):
            c = _terms.counts(b.column("text").to_pylist())
            total += (c > 0).sum(0)
            rows += int((c[:, :WORDS].sum(1) > 0).sum())
        if rows:
            held = np.append(total, rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held), dtype=np.int32)), pa.array(held)], ["term", "n"])

    sums = common.map_batches(docs.select("text"), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(TERMS + 1, np.int64)
    for r in sums.toLocalIterator():  # TERMS + 1 rows at most
        out[r.term] = r.n
    return out[:TERMS], int(out[TERMS])


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    total = np.maximum(counts[:, :WORDS].sum(1, keepdims=True), 1)
    return np.sqrt(counts / total) * idf


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = weighted(counts, self.idf) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        cosine = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** POWER
        votes = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.where(counts.sum(1) > 0, votes, self.labels.mean())


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Model | None:
    ids = common.written(sample_ids(labels, usable, "quality", sample), "quality-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, BLOCK):
            c = _terms.counts(b.column("text").to_pylist())
            rows = [pa.array(list(c), pa.list_(pa.float32())), b.column("y"), b.column("doc_id").cast(pa.string())]
            yield pa.RecordBatch.from_arrays(rows, ["c", "y", "id"])

    # The sample has 2 * SAMPLE ids at most.
    rows = docs.join(F.broadcast(ids), "doc_id").select("text", "y", "doc_id")
    got = common.map_batches(rows, run, "c array<float>, y int, id string")
    got = got.groupBy("id").agg(F.max("c").alias("c"), F.max("y").alias("y")).orderBy("id").toArrow()
    if got.num_rows == 0:
        return None
    held, many = frequencies(docs)
    idf = np.log((many + 1) / (held + 1)) + 1
    idf[WORDS:] *= SHAPE_WEIGHT
    c = np.array(got.column("c").to_pylist(), np.float32)
    y = got.column("y").to_numpy().astype(np.float64)
    some = c.sum(1) > 0
    if not some.any():
        return None
    c, y = c[some], y[some]
    x = weighted(c, idf)
    value, vector = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = vector[:, ::-1][:, :AXES]
    model = Model(idf.astype(np.float32), axes.astype(np.float32), np.zeros((0, AXES), np.float32), y)
    model.vectors = model.project(c).astype(np.float32)
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    docs = docs.select("doc_id", "text")
    model = fit(docs, labels, ~common.held_out(F.col("doc_id"), 5, 0))
    if model is None:
        rows = docs.select("doc_id", F.lit(0.0).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in common.slices(batches, BLOCK):
                p = shared.value.vote(_terms.counts(b.column("text").to_pylist())).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.clip(p, 0, 1))], ["doc_id", "score"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        rows = common.map_batches(docs, run, f"doc_id {kind}, score double")
    return rows.select(
        "doc_id",
        F.coalesce(common.held_out(F.col("doc_id"), 5, 0), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
