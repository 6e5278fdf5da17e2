"""Toxicity: a support vector machine on a subsequence string kernel with Nystrom landmarks, trained on labelled sentences.

Kernel.  A word is mapped to all its subsequences of three characters, each weighted by DECAY for every character skipped,
however many; a start mark counts as a character.  The kernel of two words is the cosine of their maps, so an insult keeps
most of its similarity when characters are dropped from it or put between its letters.  Words longer than WIDTH are read
in overlapping windows, each a word.

Training.  Sentences carry their document's label, and as a toxic document has clean sentences too, labels of its
sentences are imputed, as in multiple-instance machines: a sentence is as toxic as its worst word.  At first a sentence of
a toxic document counts as toxic if it holds a word beyond doubt (log-likelihood ratio over all sentences of the sample);
then the machine itself decides which are, and is fitted anew.  Each round it is fitted on the worst words of toxic
sentences against the worst and hash-drawn words of clean documents, kernels with landmarks from both being the
coordinates.  A document's margin is that of its worst sentence.  On labelled documents that were kept apart, margins
are calibrated so that the best cut scores THRESHOLD.

Scoring.  The machine is linear in the subsequences, so weights of landmarks are folded into one weight a subsequence and
no landmark is visited; a word's norm comes from the kernel's recursion.  Beside its words a text is scored by those that
it may hide: runs of single characters ("i d i o t"), a word's letters without what stands between them
("i--d--i--o--t"), and neighbouring words of JOINED letters at most together ("id iot").  Insults of more letters are
not joined.  Each distinct word is scored once a worker, as long as its memo holds.

Bounds of the training sample, the only sampling: SAMPLE documents a class; a round learns from SENTENCES sentences of a
toxic document and DRAWN + 1 words of a clean one; LANDMARKS.

Defined results: null and empty texts score as a document without words, 0; rows without a label or with a null label
are not learned from; with no label of either class all scores are 0; repeated rows score alike; labels are averaged if
a doc_id has several; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

DECAY = 0.5
WIDTH = 32
#: Letters of neighbouring words that are read as one.
JOINED = 10
LETTERS = 62
SAMPLE = 4000
ROUNDS = 2
#: Sentences of a toxic document that are learned from each round, and words of a clean one that are drawn by hash.
SENTENCES, DRAWN = 8, 2
#: Log-likelihood ratio from which a word makes a sentence toxic at first.
SIGNIFICANT = 12.0
#: Words of a sentence at most; longer ones are read in parts.
SENTENCE_WORDS = 40
LANDMARKS = 512
THRESHOLD = 0.3
#: Clean documents are to be kept: precision weighs more in the cut, which stays on the toxic side of the machine.
BETA, MIN_CUT = 0.5, 0.5
#: Words, and joined words, that a worker remembers.
MEMO, MEMO_JOINED = 150_000, 250_000
#: Rows whose margins are taken at once.
BLOCK = 256
#: Subsequences that are looked up at once.
TRIPLES = 400_000
START = "\2"
BETWEEN = re.compile(r"[\W\d_]+")
SENTENCE_END = re.compile(r"[.!?;:。！？]+(?:\s+|\Z)|[\r\n]+")


def sentences(text: str | None) -> Iterator[list[str]]:
    """The lower-case words of each sentence, SENTENCE_WORDS at a time."""
    for part in SENTENCE_END.split((text or "").lower()):
        words = part.split()
        for at in range(0, len(words), SENTENCE_WORDS):
            yield words[at : at + SENTENCE_WORDS]


def pieces(word: str) -> list[str]:
    """The windows that a word is read in; the first begins with a start mark."""
    if len(word) < WIDTH:
        return [START + word]
    half = WIDTH // 2
    return [(START if at == 0 else "") + word[at : at + WIDTH - (at == 0)] for at in range(0, max(1, len(word) - half), half)]


def bare(word: str) -> str:
    """The word's letters."""
    return word if word.isalpha() else BETWEEN.sub("", word)


def instances(text: str | None) -> set[str]:
    """All that a text is scored by: its words and those that it may hide.  As Scorer does it, a word at a time."""
    words = (text or "").lower().split()
    out = set(words)
    run: list[str] = []
    for w in [*words, ""]:
        if len(w) == 1:
            run.append(w)
        else:
            if len(run) > 2:
                out.add("".join(run))
            run = []
    letters = [bare(w) for w in words]
    out.update(b for w, b in zip(words, letters, strict=True) if len(b) > 2 and b not in w)
    letters = [b for b in letters if b]
    for i in range(len(letters)):
        for k in range(i + 2, len(letters) + 1):
            joined = "".join(letters[i:k])
            if len(joined) > JOINED:
                break
            if len(joined) > 2:
                out.add(joined)
    return out


@dataclass
class Alphabet:
    """Character numbers: 0 no letter, 1 other letters, 2 start of a word, then the LETTERS - 1 most frequent."""

    numbers: dict[str, int] = field(default_factory=dict)
    #: Numbers by code point, filled as characters are met; -2 for none yet.
    table: np.ndarray | None = field(default=None, compare=False, repr=False)

    @classmethod
    def of(cls, words: list[str]) -> Alphabet:
        counts = Counter(c for w in words for c in w if c.isalpha())
        top = sorted(counts, key=lambda c: (-counts[c], c))[: LETTERS - 1]
        return cls({c: i + 3 for i, c in enumerate(top)})

    def number(self, c: str) -> int:
        return 2 if c == START else self.numbers.get(c) or int(c.isalpha())

    def __getstate__(self) -> dict:
        return {"numbers": self.numbers, "table": None}

    def rows(self, texts: list[str], size: int) -> np.ndarray:
        """Numbers of the characters of texts that all have so many."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        if self.table is None:
            self.table = np.full(0x110000, -2, np.int8)
        out = self.table[points]
        if (out == -2).any():
            for p in set(points[out == -2].tolist()):
                self.table[p] = self.number(chr(p))
            out = self.table[points]
        return out.reshape(len(texts), size).astype(np.int32)


def by_length(texts: list[str], most: int = 2048) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of texts of a length together, as their subsequences grow with the cube of it."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for size in np.unique(sizes).tolist():
        which = np.nonzero(sizes == size)[0]
        for at in range(0, len(which), most):
            yield size, which[at : at + most]


@lru_cache(64)
def triples(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all subsequences of a row, and their weights."""
    i, j, k = np.array(list(combinations(range(width), 3)), np.int64).reshape(-1, 3).T
    return i, j, k, DECAY ** (k - i - 2.0)


@lru_cache(64)
def decays(width: int) -> np.ndarray:
    """[x, y]: DECAY for each character between y and a later x."""
    gap = np.arange(width)[:, None] - np.arange(width)[None, :] - 1
    return np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0.0).astype(np.float32)


def subsequences(texts: list[str], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, subsequence, weight), equal subsequences of a text summed; those with a character that is no letter left out."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for size, which in by_length(texts, 512):
        if size < 3:
            continue
        rows = alphabet.rows([texts[w] for w in which.tolist()], size).astype(np.int64)
        i, j, k, weight = triples(size)
        keys = (which[:, None] << 18) | (rows[:, i] << 12) | (rows[:, j] << 6) | rows[:, k]
        ok = (rows[:, i] > 0) & (rows[:, j] > 0) & (rows[:, k] > 0)
        keys, weights = keys[ok], np.broadcast_to(weight, ok.shape)[ok]
        kinds, where = np.unique(keys, return_inverse=True)
        parts.append((kinds, np.bincount(where.ravel(), weights, len(kinds))))
    keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    weights = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
    order = np.argsort(keys, kind="stable")
    return keys[order] >> 18, keys[order] & ((1 << 18) - 1), weights[order]


def unit_maps(texts: list[str], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """subsequences() with each text's weights of norm 1."""
    row, sub, weight = subsequences(texts, alphabet)
    norm = np.sqrt(np.bincount(row, weight * weight, len(texts)))
    return row, sub, weight / np.maximum(norm, 1e-12)[row]


def self_kernels(rows: np.ndarray) -> np.ndarray:
    """Squared norms of the maps of rows of a length, by the kernel's recursion over prefixes."""
    n, m = rows.shape[1], len(rows)
    seen = np.ascontiguousarray(rows.T)
    equal = ((seen[:, None, :] == seen[None, :, :]) & (seen > 0)[:, None, :]).astype(np.float32)
    step = decays(n)
    paths = equal
    for _ in range(2):
        # Shorter paths that end before both places, less for each character skipped on either side.
        half = (step @ paths.reshape(n, n * m)).reshape(n, n, m)
        whole = (step @ np.ascontiguousarray(half.transpose(1, 0, 2)).reshape(n, n * m)).reshape(n, n, m)
        paths = equal * whole.transpose(1, 0, 2)
    return paths.sum(axis=(0, 1))


def cosines(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of a row's subsequences over their norm; 0 for a row without any.

    weights are 0 for subsequences with a character that is no letter.
    """
    out = np.zeros(len(rows), np.float32)
    i, j, k, weight = triples(rows.shape[1])
    if not len(i):
        return out
    weight = weight.astype(np.float32)
    step = max(1, TRIPLES // max(len(i), rows.shape[1] ** 2))
    for at in range(0, len(rows), step):
        some = np.ascontiguousarray(rows[at : at + step].T)
        keys = (some << 12)[i]
        keys |= (some << 6)[j]
        keys |= some[k]
        value = weight @ weights.take(keys)
        norm = np.sqrt(self_kernels(rows[at : at + step]))
        out[at : at + step] = np.where(norm > 0, value / np.maximum(norm, 1e-12), 0.0)
    return out


@dataclass
class Model:
    alphabet: Alphabet
    #: By subsequence; 0 for those with a character that is no letter.
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def piece_margins(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.float32)
        for size, which in by_length(texts):
            if size:
                out[which] = cosines(self.alphabet.rows([texts[w] for w in which.tolist()], size), self.weights)
        return out + np.float32(self.bias)

    def margins(self, words: list[str]) -> np.ndarray:
        """That of each word's worst window."""
        if all(len(w) < WIDTH for w in words):
            return self.piece_margins([START + w for w in words])
        read = [pieces(w) for w in words]
        ends = np.cumsum([len(p) for p in read])
        return np.maximum.reduceat(self.piece_margins([p for ps in read for p in ps]), ends - [len(p) for p in read])

    def probability(self, margin: np.ndarray) -> np.ndarray:
        z = np.clip(self.scale * margin + self.shift, -40, 40)
        return np.where(np.isneginf(margin), 0.0, 1 / (1 + np.exp(-z)))


class Table:
    """A growing array."""

    def __init__(self, kind: type):
        self.held, self.size = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.size + len(values) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.size : self.size + len(values)] = values
        self.size += len(values)


class Scorer:
    """Worst margin of texts over instances(), with a bounded memo of words and of joined neighbours."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.letters: list[str] = []
        self.margin, self.size, self.single = Table(np.float32), Table(np.int64), Table(bool)
        self.clear_joined()

    def clear_joined(self) -> None:
        #: Numbers of joined words by the joined word (or, negative, the word) before and the word after.
        self.joined: dict[int, int] = {}
        self.joined_text: list[str] = []
        self.joined_margin = Table(np.float32)

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.ids]
        if not fresh:
            return
        self.ids.update(zip(fresh, range(len(self.ids), len(self.ids) + len(fresh)), strict=True))
        letters = [bare(w) for w in fresh]
        margin = self.model.margins(fresh)
        hidden = [k for k, (w, b) in enumerate(zip(fresh, letters, strict=True)) if b is not w and len(b) > 2 and b not in w]
        if hidden:
            margin[hidden] = np.maximum(margin[hidden], self.model.margins([letters[k] for k in hidden]))
        sizes = np.fromiter(map(len, letters), np.int64, len(letters))
        self.letters += [b if len(b) < JOINED else "" for b in letters]
        self.margin.add(margin)
        self.size.add(sizes)
        self.single.add(np.fromiter(map(len, fresh), np.int64, len(fresh)) == 1)

    def worst(self, texts: list[str | None]) -> np.ndarray:
        if len(self.ids) > MEMO:
            self.clear()
        if len(self.joined_text) > MEMO_JOINED:
            self.clear_joined()
        lists = [(t or "").lower().split() for t in texts]
        out = np.full(len(texts), -np.inf, np.float32)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        if not counts.sum():
            return out.astype(np.float64)
        self.learn(set().union(*lists))
        get = self.ids.__getitem__
        ids = np.fromiter((i for words in lists for i in map(get, words)), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(texts)), counts)
        np.maximum.at(out, owner, self.margin.held[ids])
        self._runs(lists, ids, owner, out)
        self._neighbours(ids, owner, out)
        return out.astype(np.float64)

    def _runs(self, lists: list[list[str]], ids: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        """Runs of three single characters or more, as words."""
        single = self.single.held[ids]
        three = single[:-2] & single[1:-1] & single[2:] & (owner[:-2] == owner[2:])
        if not three.any():
            return
        found: dict[str, int] = {}
        who, what = [], []
        for text in np.unique(owner[:-2][three]).tolist():
            for run in "".join(w if len(w) == 1 else "\0" for w in lists[text]).split("\0"):
                if len(run) > 2:
                    who.append(text)
                    what.append(found.setdefault(run, len(found)))
        np.maximum.at(out, np.array(who), self.model.margins(list(found))[np.array(what)])

    def _neighbours(self, ids: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        """Neighbouring words that have JOINED letters at most together."""
        some = self.size.held[ids] > 0
        ids, owner = ids[some], owner[some]
        size = self.size.held[ids]
        at = np.nonzero(size < JOINED)[0]
        total, before = size[at], -1 - ids[at]
        n = 1
        while True:
            last = at + n
            ok = last < len(ids)
            at, total, before, last = at[ok], total[ok], before[ok], last[ok]
            total = total + size[last]
            ok = (owner[at] == owner[last]) & (total <= JOINED)
            at, total, before, last = at[ok], total[ok], before[ok], last[ok]
            if not len(at):
                return
            kinds, where = np.unique((before << 24) + ids[last], return_inverse=True)
            number = self._join(kinds)
            before = number[where.ravel()]
            np.maximum.at(out, owner[at], self.joined_margin.held[before])
            n += 1

    def _join(self, kinds: np.ndarray) -> np.ndarray:
        """Numbers of joined words, by what is joined."""
        known = [self.joined.get(k, -1) for k in kinds.tolist()]
        number = np.array(known, np.int64)
        fresh = np.nonzero(number < 0)[0]
        if len(fresh):
            texts = []
            for k in kinds[fresh].tolist():
                before, word = k >> 24, k & 0xFFFFFF
                texts.append((self.letters[-1 - before] if before < 0 else self.joined_text[before]) + self.letters[word])
            number[fresh] = np.arange(len(self.joined_text), len(self.joined_text) + len(fresh))
            self.joined.update(zip(kinds[fresh].tolist(), number[fresh].tolist(), strict=True))
            self.joined_text += texts
            margin = self.model.piece_margins([START + t for t in texts])
            margin[[len(t) < 3 for t in texts]] = -np.inf
            self.joined_margin.add(margin)
        return number


_scorers: dict[str, Scorer] = {}


def scorer(key: str, model: Model) -> Scorer:
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def sample_ids(labels: DataFrame, usable: Column, label: str, per_class: int) -> DataFrame:
    """doc_id, y: at most per_class ids of each class, those with the least hashes."""
    rows = labels.where(usable & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    rows = rows.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    rows = rows.withColumn("h", F.md5(F.col("doc_id").cast("string").cast("binary")))
    picks = [rows.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    return picks[0].union(picks[1]).select("doc_id", "y", (F.conv(F.substring("h", 31, 2), 16, 10).cast("int") < 64).alias("apart"))


def _hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def supports(sample: DataFrame) -> DataFrame:
    """doc_id, y, n (of the sentence), word, ratio of the words of the sample's sentences that are toxic beyond doubt.

    A word's support in a class is the number of different words that it follows there, so copies of a text count once;
    ratio is the log-likelihood ratio of its supports.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 100):
            rows: list[tuple[int, int, str, int]] = []
            for i, text in enumerate(b.column("text").to_pylist()):
                for n, words in enumerate(sentences(text)):
                    follows = dict(zip(reversed(words), reversed(["", *words[:-1]]), strict=True))
                    rows += [(i, n, p, _hashed(before)) for w, before in follows.items() for p in pieces(w)]
            at, n, word, before = zip(*rows, strict=True) if rows else ((), (), (), ())
            at = pa.array(at, pa.int64())
            cols = [b.column("doc_id").take(at), b.column("y").take(at), pa.array(n, pa.int32()), pa.array(word, pa.string()), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "y", "n", "word", "before"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = common.map_batches(sample.select("doc_id", "y", "text"), run, f"doc_id {kind}, y int, n int, word string, before long")
    rows = common.written(rows, "toxic-sentences")
    counts = rows.select("word", "before", "y").distinct().groupBy("word")
    counts = counts.agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    counts = common.written(counts, "toxic-words")
    bad, good = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    a, b, total = F.col("toxic"), F.col("clean"), F.lit(float(bad + good))

    def term(seen: Column, rows: float, both: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * total / (F.lit(float(max(1, rows))) * both))).otherwise(0.0)

    out, rest = F.lit(float(bad)) - a, F.lit(float(good)) - b
    ratio = 2 * (term(a, bad, a + b) + term(b, good, a + b) + term(out, bad, out + rest) + term(rest, good, out + rest))
    tested = counts.select("word", ratio.alias("ratio")).where((F.col("ratio") >= SIGNIFICANT) & (a * max(1, good) > 8 * b * bad))
    return rows.where("y = 1").join(tested, "word").select("doc_id", "y", "n", "word", "ratio")


def found_toxic(sample: DataFrame) -> Counter:
    """The words that make sentences toxic beyond doubt, by sentences: of each sentence its worst, of a document SENTENCES."""
    worst = supports(sample).groupBy("doc_id", "n").agg(F.max(F.struct("ratio", "word")).alias("m"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("m"), "n")
    some = worst.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SENTENCES)
    rows = some.groupBy(F.col("m.word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return Counter({r.word: r.n for r in rows.collect()})  # SENTENCES rows a document of the sample at most


def named_words(sample: DataFrame, model: Model | None, seed: int) -> tuple[Counter, Counter]:
    """(words that make sentences of toxic documents toxic, words of clean documents), with numbers of sentences; as pieces().

    A sentence of a toxic document is toxic if its worst word is; a document's SENTENCES worst ones count.  Clean documents
    give the worst word of their worst sentence, and DRAWN words by hash.  Without a model there are drawn words alone.
    """
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in common.slices(batches, 100):
            texts = [[{p for w in s for p in pieces(w)} for s in sentences(t)] for t in b.column("text").to_pylist()]
            words = sorted(set().union(*(s for t in texts for s in t)))
            margin = dict(zip(words, model.piece_margins(words).tolist(), strict=True)) if model else {}
            rows: list[tuple[int, int, float, str]] = []
            for i, (text, y, doc_id) in enumerate(zip(texts, b.column("y").to_pylist(), b.column("doc_id").to_pylist(), strict=True)):
                worst = sorted((max((margin[p], p) for p in s) for s in text if s), reverse=True) if model else []
                rows += [(i, k, *x) for k, x in enumerate(worst[: SENTENCES if y else 1]) if x[0] > 0 or not y]
                if not y:
                    drawn = sorted((_hashed(f"{seed}:{doc_id}:{p}"), p) for p in set().union(*text))[:DRAWN]
                    rows += [(i, SENTENCES + k, float(h), p) for k, (h, p) in enumerate(drawn)]
            at, slot, rank, word = zip(*rows, strict=True) if rows else ((), (), (), ())
            at = pa.array(at, pa.int64())
            cols = [b.column("doc_id").take(at), b.column("y").take(at), pa.array(slot, pa.int32()), pa.array(rank, pa.float64()), pa.array(word, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "y", "slot", "rank", "word"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = common.map_batches(sample.select("doc_id", "y", "text"), run, f"doc_id {kind}, y int, slot int, rank double, word string")
    rows = rows.groupBy("doc_id", "y", "slot").agg(F.max(F.struct("rank", "word")).alias("m"))
    toxic, clean = Counter(), Counter()
    for r in rows.groupBy("y", F.col("m.word").alias("word")).agg(F.count(F.lit(1)).alias("n")).collect():  # a few words a document of the sample
        (toxic if r.y else clean)[r.word] += r.n
    return toxic, clean


def fit_machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the margin violators, summed in blocks of rows."""
    n = x.shape[1]
    w = np.zeros(n + 1)
    keep = np.full(n + 1, penalty)
    keep[-1] = 1e-8
    for _ in range(rounds):
        grad, curve = keep * w, np.diag(keep)
        for at in range(0, len(x), BLOCK):
            some = slice(at, at + BLOCK)
            rows = np.hstack([x[some].astype(np.float64), np.ones((len(x[some]), 1))])
            out = 1 - y[some] * (rows @ w)
            hot = out > 0
            rows, c = rows[hot], cost[some][hot]
            grad -= rows.T @ (c * y[some][hot] * out[hot])
            curve += rows.T @ (rows * c[:, None])
        step = np.linalg.solve(curve, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def spread(items: list, n: int, key=str) -> list:
    """n of the items, drawn by hash."""
    return sorted(items, key=lambda x: hashlib.md5(key(x).encode("utf-8", "surrogatepass")).digest())[:n]


def machine(landmarks: tuple, blocks: Iterator[tuple], y: np.ndarray, cost: np.ndarray, n_landmarks: int) -> tuple[np.ndarray, float]:
    """(one weight a subsequence, bias) of the machine on rows' kernels with the landmarks; maps as unit_maps() gives them."""
    row, sub, weight = landmarks
    kinds, where = np.unique(sub, return_inverse=True)
    phi = np.zeros((n_landmarks, len(kinds)), np.float32)
    phi[row, where.ravel()] = weight
    value, vector = np.linalg.eigh((phi @ phi.T).astype(np.float64))
    axes = value > 1e-5 * value.max()
    white = vector[:, axes] / np.sqrt(value[axes])
    column = np.full(1 << 18, -1, np.int64)
    column[kinds] = np.arange(len(kinds))
    # Each row's coordinates in the landmarks' space: the whitened maps of its subsequences, summed.
    base = np.ascontiguousarray(phi.T @ white.astype(np.float32))
    x = np.zeros((len(y), base.shape[1]), np.float32)
    start = 0
    for n, (row, sub, weight) in blocks:
        known = column[sub] >= 0
        row, at, weight = row[known], column[sub[known]], weight[known].astype(np.float32)
        for lo in range(0, n, 32):
            a, b = np.searchsorted(row, [lo, lo + 32])
            if a < b:
                first = np.nonzero(np.diff(row[a:b], prepend=-1))[0]
                x[start + row[a:b][first]] = np.add.reduceat(base[at[a:b]] * weight[a:b, None], first, axis=0)
        start += n
    w, bias = fit_machine(x, y, cost)
    folded = np.zeros(1 << 18, np.float32)
    folded[kinds] = base @ w
    return folded, bias


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Model | None:
    """Learns from labels of rows that are usable; None if a class has no label."""
    ids = common.written(sample_ids(labels, usable, "toxic", sample), "toxic-sample")
    # The sample has 2 * SAMPLE ids at most.
    held = common.written(docs.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y", "apart"), "toxic-texts")
    learned = held.where("not apart")
    toxic = found_toxic(learned)
    against = named_words(learned, None, 0)[1]
    alphabet = Alphabet.of([w for c in (toxic, against) for w in c])
    model = next_machine(alphabet, toxic, against)
    if model is None:
        return None
    for k in range(1, ROUNDS):
        toxic, clean = named_words(learned, model, k)
        against.update(clean)
        model = next_machine(alphabet, toxic, against) or model
    return calibrated(held, model)


def next_machine(alphabet: Alphabet, toxic: Counter, clean: Counter) -> Model | None:
    """The machine that tells words of toxic documents from words of clean ones, each counted by its documents."""
    first = sorted(toxic, key=lambda w: (-toxic[w], w))[: LANDMARKS * 2 // 3]
    landmarks = first + spread(sorted(clean), LANDMARKS - len(first))
    rows = sorted(toxic) + sorted(clean)
    n = len(toxic)
    if not n or n == len(rows):
        return None
    cost = np.concatenate([[0.5 * c[w] / sum(c.values()) for w in ws] for c, ws in ((toxic, rows[:n]), (clean, rows[n:]))])
    y = np.concatenate([np.ones(n), -np.ones(len(rows) - n)])
    steps = range(0, len(rows), BLOCK)
    blocks = ((len(rows[at : at + BLOCK]), unit_maps(rows[at : at + BLOCK], alphabet)) for at in steps)
    return Model(alphabet, *machine(unit_maps(landmarks, alphabet), blocks, y, cost, len(landmarks)))


def calibrated(sample: DataFrame, model: Model) -> Model:
    """Scale and shift that put the best cut, on documents kept apart (on all, if a class has none there), at THRESHOLD."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value)
        for b in common.slices(batches, 200):
            margins = s.worst(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(margins), b.column("y"), b.column("apart")], ["doc_id", "m", "y", "apart"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    got = common.map_batches(sample, run, f"doc_id {kind}, m double, y int, apart boolean").groupBy("doc_id", "y", "apart").agg(F.max("m").alias("m"))
    got = got.toArrow()  # a row a document of the sample
    m, y, apart = (got.column(c).to_numpy() for c in ("m", "y", "apart"))
    finite = np.isfinite(m)
    m, y, apart = m[finite], y[finite].astype(float), apart[finite].astype(bool)
    if len(set(y[apart].tolist())) == 2:
        m, y = m[apart], y[apart]
    if len(set(y.tolist())) < 2:
        return model
    cut = best_cut(m, y)
    scale = 6 / max(1e-6, abs(m[y > 0].mean() - m[y == 0].mean()))
    return Model(model.alphabet, model.weights, model.bias, scale, float(np.log(THRESHOLD / (1 - THRESHOLD)) - scale * cut))


def best_cut(margin: np.ndarray, y: np.ndarray) -> float:
    """The cut, MIN_CUT at least, with the best F score of class 1 at or above it, precision counting twice as much as
    recall; of equals, the middle of the widest gap."""
    order = np.argsort(-margin, kind="stable")
    m, hits = margin[order], np.cumsum(y[order])
    share = BETA * BETA
    f = (1 + share) * hits / (np.arange(1, len(m) + 1) + share * y.sum())
    gap = m - np.append(m[1:], m[-1] - 1)  # a cut lies below m[i] and above m[i + 1]
    f = np.where(gap > 0, f, -1)
    best = np.nonzero(f >= f.max() - 1e-12)[0]
    i = best[np.argmax(gap[best])]
    return max(MIN_CUT, float(m[i] - gap[i] / 2))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with a double column __sw_toxicity added."""
    import uuid

    if model is None:
        return docs.withColumn("__sw_toxicity", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer(key, shared.value)
        for b in common.slices(batches, 250):
            p = shared.value.probability(s.worst(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, "__sw_toxicity"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return common.map_batches(docs, run, f"{fields}, __sw_toxicity double")


def usable() -> Column:
    return ~common.held_out(F.col("doc_id"), 4, 2)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = fit(docs.select("doc_id", "text"), labels, usable())
    rows = score(docs.select("doc_id", "text"), model)
    return rows.select(
        "doc_id",
        F.coalesce(common.held_out(F.col("doc_id"), 4, 2), F.lit(False)).alias("held_out"),
        F.col("__sw_toxicity").alias("score"),
        (F.col("__sw_toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns."""
    model = fit(docs.select("doc_id", "text"), labels, usable())
    return score(docs, model).where(F.col("__sw_toxicity") < THRESHOLD).drop("__sw_toxicity")
