"""Byte-level BPE encoding and decoding.

Each match of the split pattern is encoded by itself.  A segment tree over its byte positions holds, at the leaf of
each live position, the rank of the pair that starts there, and at each inner node the minimum with the leftmost
position; the root is the next merge.  A merge removes the right half's leaf and updates the leaves of the merged token
and of its left neighbour: three logarithmic point updates.

Trees of many distinct matches advance in step as rows of NumPy arrays; a match of over LONG bytes has its own.  Encoded matches are remembered by worker, in a
bounded memo.  Ids are looked up again to decode.

Defined results: null and empty texts have no tokens and decode to nothing; repeated rows repeat; columns other than
doc_id and text are ignored; a vocabulary without all 256 single bytes is refused.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct matches that a worker remembers; beyond it, the older half goes.
MEMO = 240_000
#: Positions (matches times padded length) that trees are built for at once.
POSITIONS = 1 << 19
NONE = np.int64(1 << 62)
#: Longest matches, in bytes, whose trees advance in step with others.
LONG = 1 << 11


class Ranks:
    """Ranks of a vocabulary, and of the pairs that make each of its tokens, for lookups by arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self._by_pair: dict[int, int] | None = None
        self.tokens = {r: t for t, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.base = np.int64(max(ranks.values()) + 1)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for at in range(1, len(token)):
                a, b = ranks.get(token[:at]), ranks.get(token[at:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys = np.array(left, np.int64) * self.base + np.array(right, np.int64)
        # Open addressing: a lookup is one or a few array reads, whatever the size of the vocabulary.
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            self.keys[slot[todo[free]]] = keys[todo[free]]
            placed = self.keys[slot[todo]] == keys[todo]
            done = todo[placed]
            self.values[slot[done]] = np.array(rank, np.int64)[done]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's token, NONE where there is none."""
        keys = left * self.base + right
        slot = self._slot(keys)
        out = np.full(len(keys), NONE, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (held != -1)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out


    def by_pair(self) -> dict[int, int]:
        """Rank by pair, for lookups of one pair."""
        if self._by_pair is None:
            used = np.nonzero(self.keys >= 0)[0]
            self._by_pair = dict(zip(self.keys[used].tolist(), self.values[used].tolist(), strict=True))
        return self._by_pair


@lru_cache(maxsize=4)
def load(path: str) -> Ranks:
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    return Ranks({base64.b64decode(token): int(rank) for token, rank in rows})


def _forest(words: list[bytes], width: int, ranks: Ranks) -> list[np.ndarray]:
    """Ids of words of at most `width` bytes (a power of two, 2 at least): one segment tree a word."""
    n, depth = len(words), width.bit_length() - 1
    shift = np.int64(width)
    flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
    length = np.fromiter(map(len, words), np.int64, n)
    ids = ranks.single[flat]
    place = np.arange(width)
    live = place[None, :] < length[:, None]
    after = np.broadcast_to(place + 1, (n, width)).copy()
    before = np.broadcast_to(place - 1, (n, width)).copy()
    tree = np.full((n, 2 * width), NONE, np.int64)
    r, p = np.nonzero(place[None, :-1] + 1 < length[:, None])
    rank = ranks.pair(ids[r, p], ids[r, p + 1])
    # Rank first, then position: the minimum is the leftmost of the least rank.
    tree[r, width + p] = np.where(rank == NONE, NONE, rank * shift + p)
    for level in range(depth - 1, -1, -1):
        lo = 1 << level
        nodes = tree[:, 2 * lo : 4 * lo]
        tree[:, lo : 2 * lo] = np.minimum(nodes[:, ::2], nodes[:, 1::2])

    def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        node = width + at
        tree[rows, node] = value
        for _ in range(depth):
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.nonzero(tree[:, 1] != NONE)[0]
    while len(rows):
        root = tree[rows, 1]
        at = root % shift
        gone = after[rows, at]
        ids[rows, at] = root // shift
        live[rows, gone] = False
        follows = after[rows, gone]
        after[rows, at] = follows
        update(rows, gone, np.full(len(rows), NONE, np.int64))

        inside = follows < length[rows]
        before[rows[inside], follows[inside]] = at[inside]
        value = np.full(len(rows), NONE, np.int64)
        rank = ranks.pair(ids[rows[inside], at[inside]], ids[rows[inside], follows[inside]])
        value[inside] = np.where(rank == NONE, NONE, rank * shift + at[inside])
        update(rows, at, value)

        left = before[rows, at]
        has = left >= 0
        rank = ranks.pair(ids[rows[has], left[has]], ids[rows[has], at[has]])
        update(rows[has], left[has], np.where(rank == NONE, NONE, rank * shift + left[has]))
        rows = rows[tree[rows, 1] != NONE]
    return np.split(ids[live], np.cumsum(live.sum(1))[:-1])


def _tree(word: bytes, ranks: Ranks) -> np.ndarray:
    """Ids of one long word: the same tree as in _forest(), in plain arrays, as there is nothing to advance beside it.

    An update stops where a node keeps its minimum, so most touch a few levels.  28 bytes a position.
    """
    n = len(word)
    width = 1 << (n - 1).bit_length()
    ids = ranks.single[np.frombuffer(word, np.uint8)]
    rank = ranks.pair(ids[:-1], ids[1:])
    built = np.full(2 * width, NONE, np.int64)
    built[width : width + n - 1] = np.where(rank == NONE, NONE, rank * width + np.arange(n - 1))
    level = width
    while level > 1:
        built[level // 2 : level] = np.minimum(built[level : 2 * level : 2], built[level + 1 : 2 * level : 2])
        level //= 2
    tree = array("q", built.tobytes())
    del built
    ids, after, before = (array("i", x.astype(np.int32).tobytes()) for x in (ids, np.arange(1, n + 1), np.arange(-1, n - 1)))
    none, base, known = int(NONE), int(ranks.base), ranks.by_pair()

    def update(at: int, value: int) -> None:
        node = width + at
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    while tree[1] != none:
        rank, at = divmod(tree[1], width)
        gone = after[at]
        follows = after[gone]
        ids[at], after[at], ids[gone] = rank, follows, -1
        update(gone, none)
        if follows < n:
            before[follows] = at
            pair = known.get(rank * base + ids[follows], -1)
            update(at, none if pair < 0 else pair * width + at)
        else:
            update(at, none)
        left = before[at]
        if left >= 0:
            pair = known.get(ids[left] * base + rank, -1)
            update(left, none if pair < 0 else pair * width + left)
    out = np.frombuffer(ids, np.int32).astype(np.int64)
    return out[out >= 0]


def encode_words(words: list[bytes], ranks: Ranks) -> list[np.ndarray]:
    """The ids of each match."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
    by_width: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        whole = ranks.ranks.get(w)
        if whole is not None:
            out[i] = np.array([whole], np.int64)
        elif w:
            by_width.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
    for width, which in by_width.items():
        if width > LONG:
            for i in which:
                out[i] = _tree(words[i], ranks)
            continue
        rows = max(1, POSITIONS // width)
        for at in range(0, len(which), rows):
            some = which[at : at + rows]
            for i, ids in zip(some, _forest([words[i] for i in some], width, ranks), strict=True):
                out[i] = ids
    return out


class Codec:
    """Encodes texts with a memo of (ids as text, number of ids, bytes decoded from the ids) by match."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load(path)
        self.split = regex.compile(pattern).findall
        self.new: dict[str, tuple[bytes, int, bytes]] = {}
        self.old: dict[str, tuple[bytes, int, bytes]] = {}

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids in encode_words([m.encode() for m in self.split(text)], self.ranks) for i in ids]

    def learn(self, matches: set[str]) -> None:
        fresh = [m for m in matches if m not in self.new]
        kept = [m for m in fresh if m in self.old]
        for m in kept:
            self.new[m] = self.old[m]
        fresh = [m for m in fresh if m not in self.old]
        for m, ids in zip(fresh, encode_words([m.encode("utf-8", "surrogatepass") for m in fresh], self.ranks), strict=True):
            listed = ids.tolist()
            self.new[m] = (",".join(map(str, listed)).encode(), len(listed), self.decode(listed))

    def trim(self) -> None:
        if len(self.new) > MEMO // 2:
            self.old, self.new = self.new, {}

    def digest(self, matches: list[str]) -> tuple[int, str, str]:
        found = [self.new[m] for m in matches]
        ids, decoded = hashlib.sha256(b",".join([x[0] for x in found])), hashlib.sha256(b"".join([x[2] for x in found]))
        return sum([x[1] for x in found]), ids.hexdigest(), decoded.hexdigest()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_digests(docs: DataFrame, path: str, pattern: str, chars: int = 1 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256.  chars: text that is split at once, in characters."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in common.slices(batches, 500):
            rows: list[tuple[int, str, str]] = []
            texts = [t or "" for t in b.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto]) <= chars):
                    size += len(texts[upto])
                    upto += 1
                matches = [c.split(t) for t in texts[at:upto]]
                c.learn(set().union(*matches))
                rows += [c.digest(m) for m in matches]
                c.trim()
                at = upto
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return common.map_batches(docs.select("doc_id", "text"), run, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int), text decoded from the ids again."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in common.slices(batches, 200):
            ids = [c.encode(t or "") for t in b.column("text").to_pylist()]
            cols = [b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(i).decode() for i in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "text"])

    return common.map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids array<int>, text string")
