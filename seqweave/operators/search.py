"""Corpus search: exact, seeded ungapped, within mismatches; nucleotide or six-frame protein; ranked.

The substring join is rewritten as an equi-join on k-mers and a verification, so that Spark hashes instead of looping.
The probes are the small side; targets are streamed, never shuffled, while the probes' k-mers are few enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import rev_comp, translate_frame
from ..shipping import ship
from .ambiguous import scanned
from .tables import CHUNK, chunked, kmers, small

SEED = 11
PREFIX = 12
MIN_IDENTITY, MIN_COVERAGE, DROP = 0.8, 0.5, 8
TOP = 500
#: Letters of probes that go to the executors at once; more are done block by block.
PROBE_LETTERS = 4_000_000
#: Letters of probes that are compared with a text at once.
CELLS = 2_000_000
#: Letters of texts that are looked up at once.
STRETCH = 1 << 18
#: Hits that a task holds before it passes them on.
FOUND = 100_000


def both_strands(queries: DataFrame, text: str = "sequence") -> DataFrame:
    """queries with strand and probe: the query and its reverse complement, once if they are equal."""
    ahead = queries.select("*", F.lit(1).alias("strand"), F.col(text).alias("probe"))
    back = queries.select("*", F.lit(-1).alias("strand"), rev_comp(text).alias("probe"))
    return ahead.union(back.where(F.col("probe") != F.col(text)))


class Prefixes:
    """Probes by the number that their first k letters make, sorted, for lookups of whole texts at once."""

    def __init__(self, probes: list[str]):
        codes = [_codes(p) for p in probes]
        self.lengths = np.array([len(c) for c in codes], np.int64)
        self.k = min(PREFIX, int(self.lengths.min()))
        self.letters = np.zeros((len(codes), int(self.lengths.max())), np.uint8)
        for i, c in enumerate(codes):
            self.letters[i, : len(c)] = c
        first = np.array([int(_rolled(c[: self.k], self.k)[0]) for c in codes], np.uint64)
        self.order = np.argsort(first, kind="stable")
        self.keys = first[self.order]

    def of(self, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, probe) of every occurrence, by stretches of the text."""
        for start in range(0, len(text), STRETCH):
            rolled = _rolled(text[start : start + STRETCH + self.k - 1], self.k)
            lo = np.searchsorted(self.keys, rolled)
            maybe = np.nonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == rolled)[0]
            lo, hi = lo[maybe], np.searchsorted(self.keys, rolled[maybe], "right")
            n = hi - lo
            for some in np.array_split(np.arange(len(maybe)), max(1, int(n.sum()) * self.letters.shape[1] // CELLS)):
                at = np.repeat(maybe[some] + start, n[some])
                ends = np.cumsum(n[some])
                which = self.order[np.repeat(lo[some], n[some]) + np.arange(len(at)) - np.repeat(ends - n[some], n[some])]
                yield self._equal(text, at, which)

    def _equal(self, text: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those whose letters all agree: the numbers only propose."""
        fits = at + self.lengths[which] <= len(text)
        at, which = at[fits], which[fits]
        step = 8
        for lo in range(0, self.letters.shape[1], step):
            column = np.arange(lo, min(lo + step, self.letters.shape[1]))
            own = self.letters[which[:, None], column]
            same = (text[np.minimum(at[:, None] + column, len(text) - 1)] == own) | (column >= self.lengths[which][:, None])
            held = same.all(1)
            at, which = at[held], which[held]
        return at, which


def occurrences(targets: DataFrame, text: str, probes: DataFrame, probe: str = "probe", around: int | None = None) -> DataFrame:
    """Every occurrence of each probe in each target's text, overlaps included: the other columns of both, and at.

    Targets and probes must not share column names.  around: adds chunk, the text up to so many letters before and behind
    the probe, and _i, the probe's place in it.  Probes of PROBE_LETTERS letters at most go to the executors and targets are
    mapped where they lie; more are joined by k-mer, and both sides are shuffled.
    """
    probes = probes.where(F.length(probe) > 0)
    least, most, letters = probes.agg(F.min(F.length(probe)), F.max(F.length(probe)), F.sum(F.length(probe))).first()
    if least is None:
        none = targets.drop(text).join(probes, F.lit(False)).withColumn("at", F.lit(0))
        return none.withColumns({"chunk": F.lit(""), "_i": F.lit(0)}) if around is not None else none
    if letters <= PROBE_LETTERS:
        return _mapped(targets, text, probes, probe, around)
    k, side = min(PREFIX, least), around or 0
    keyed = probes.withColumn("_key", F.substr(F.col(probe), F.lit(1), F.lit(k)))
    found = kmers(targets, text, k, side, most + side, kmer="_kmer").join(keyed, F.col("_kmer") == F.col("_key"))
    exact = F.substr(F.col("chunk"), F.col("_i") + 1, F.length(probe)) == F.col(probe)
    found = found.where(exact).drop("_kmer", "_key", "chunk_at", "chunk_base")
    return found if around is not None else found.drop("chunk", "_i")


def _mapped(targets: DataFrame, text: str, probes: DataFrame, probe: str, around: int | None) -> DataFrame:
    held = probes.toArrow().combine_chunks()  # PROBE_LETTERS letters at most
    shared = targets.sparkSession.sparkContext.broadcast(held)
    rest = [c for c in targets.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.to_batches()[0]
        words = table.column(probe).to_pylist()
        index = Prefixes(words)
        for b in batches:
            for part in (b.slice(at, 500) for at in range(0, b.num_rows, 500)):
                texts = [t or "" for t in part.column(text).to_pylist()]
                # Texts lie one behind the other with a letter between them that no probe has.
                ends = np.cumsum([len(t) + 1 for t in texts])
                foreign = not all(map(str.isascii, texts))
                joined = np.frombuffer("\0".join(texts).encode("latin-1", "replace"), np.uint8)
                for place, which in index.of(joined):
                    row = np.searchsorted(ends, place, "right")
                    at = place - np.append(0, ends[:-1])[row]
                    if foreign:
                        # Letters beyond Latin-1 have all been read as one.
                        same = np.array([texts[r].startswith(words[w], i) for r, i, w in zip(row.tolist(), at.tolist(), which.tolist(), strict=True)], bool)
                        row, at, which = row[same], at[same], which[same]
                    if not len(row):
                        continue
                    cols = [*part.drop_columns([text]).take(pa.array(row)).columns, *table.take(pa.array(which)).columns, pa.array(at.astype(np.int32))]
                    if around is not None:
                        first = np.maximum(at - around, 0)
                        last = at + index.lengths[which] + around
                        chunks = [texts[r][a:z] for r, a, z in zip(row.tolist(), first.tolist(), last.tolist(), strict=True)]
                        cols += [pa.array(chunks, pa.string()), pa.array((at - first).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, [*rest, *table.schema.names, "at", *(["chunk", "_i"] if around is not None else [])])

    fields = [(c, targets.schema[c]) for c in rest] + [(c, probes.schema[c]) for c in probes.columns]
    schema = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in fields) + ", at int" + (", chunk string, _i int" if around is not None else "")
    ship(targets.sparkSession)
    return targets.mapInArrow(run, schema)


def exact_search(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, file, name, start, end, strand, length, identity, score, frame of every exact hit on both strands.

    corpus: file, name, sequence; queries: query_id, sequence.  Targets are linear.
    """
    probes = both_strands(queries.select("query_id", F.col("sequence").alias("query")), "query").drop("query")
    hits = occurrences(corpus.select("file", "name", "sequence"), "sequence", probes)
    n = F.length("probe").cast("long")
    return hits.select(
        "query_id", "file", "name", F.col("at").cast("long").alias("start"), (F.col("at") + n - 1).alias("end"), "strand",
        n.alias("length"), F.lit(1.0).alias("identity"), n.alias("score"), F.lit(None).cast("int").alias("frame"),
    )


def six_frames(corpus: DataFrame, text: str = "sequence") -> DataFrame:
    """corpus without text, with frame (1 to 3, -1 to -3), strand, frame_at (offset on its strand), protein, bases (length)."""
    rest = [c for c in corpus.columns if c != text]
    strands = F.explode(F.array(*[F.struct(F.lit(s).alias("strand"), b.alias("read")) for s, b in ((1, F.col(text)), (-1, rev_comp(text)))]))
    read = corpus.select(*rest, F.length(text).alias("bases"), strands.alias("s")).select(*rest, "bases", "s.strand", "s.read")
    frames = F.array(*[F.struct(F.lit(o).alias("frame_at"), translate_frame("read", o).alias("protein")) for o in range(3)])
    out = read.select(*rest, "bases", "strand", F.explode(frames).alias("f"))
    return out.select(*rest, "bases", "strand", (F.col("strand") * (F.col("f.frame_at") + 1)).alias("frame"), "f.frame_at", "f.protein")


def residues_to_bases(at: Column, residues: Column, frame_at: Column, strand: Column, bases: Column) -> tuple[Column, Column]:
    """(start, end) in nucleotides, on the forward strand, of a run of residues."""
    first = frame_at + at * 3
    last = first + residues * 3 - 1
    return (
        F.when(strand > 0, first).otherwise(bases - 1 - last).cast("long"),
        F.when(strand > 0, last).otherwise(bases - 1 - first).cast("long"),
    )


def protein_exact_search(corpus: DataFrame, peptides: DataFrame) -> DataFrame:
    """As exact_search, peptides (query_id, sequence) in all six frames; length in residues, coordinates in bases."""
    frames = six_frames(corpus.select("file", "name", "sequence"))
    hits = occurrences(frames, "protein", peptides.select("query_id", F.col("sequence").alias("probe")))
    n = F.length("probe").cast("long")
    start, end = residues_to_bases(F.col("at"), n, F.col("frame_at"), F.col("strand"), F.col("bases"))
    return hits.select(
        "query_id", "file", "name", start.alias("start"), end.alias("end"), "strand", n.alias("length"),
        F.lit(1.0).alias("identity"), n.alias("score"), "frame",
    )


# ---- seeded ungapped search


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("latin-1", "replace"), np.uint8)


def _rolled(codes: np.ndarray, k: int) -> np.ndarray:
    """The k-mer at each place as one number, five bits a letter: one for one on upper-case letters, others may collide."""
    if k > PREFIX:
        raise ValueError(f"seeds have {PREFIX} letters at most")
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    five = (codes & 31).astype(np.uint64)
    for j in range(k):
        out = (out << np.uint64(5)) | five[j : j + n]
    return out


class Seeds:
    """First place of every k-mer of every probe, sorted, for lookups of whole texts at once."""

    def __init__(self, probes: list[str], k: int):
        self.k = k
        codes = [_codes(p.upper()) for p in probes]
        self.lengths = np.array([len(c) for c in codes], np.int64)
        self.letters = np.zeros((len(codes), int(self.lengths.max(initial=1))), np.uint8)
        kmer, which, place = [], [], []
        for i, p in enumerate(codes):
            self.letters[i, : len(p)] = p
            values, first = np.unique(_rolled(p, k), return_index=True)
            kmer.append(values)
            which.append(np.full(len(values), i))
            place.append(first)
        self.kmer = np.concatenate(kmer) if kmer else np.zeros(0, np.uint64)
        order = np.argsort(self.kmer, kind="stable")
        self.kmer = self.kmer[order]
        self.which = np.concatenate(which)[order] if which else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int64)

    def of(self, text: np.ndarray, ends: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(probe, place in it, place in text) of the first seed of every diagonal, by stretches with about CELLS seeds at most.

        ends: of texts that lie one behind the other, each with one more letter behind it; seeds lie within one, and each text has its
        own diagonals.  A diagonal that was met is remembered only as long as the text's further letters can be on it, a probe's length: memory
        is bounded by the probes, also where one k-mer is everywhere.
        """
        longest, seen = self.letters.shape[1], np.zeros(0, np.int64)
        ends = np.array([len(text) + 1]) if ends is None else ends
        for start in range(0, len(text) - self.k + 1, STRETCH):
            rolled = _rolled(text[start : start + STRETCH + self.k - 1], self.k)
            lo, hi = np.searchsorted(self.kmer, rolled, "left"), np.searchsorted(self.kmer, rolled, "right")
            met = np.nonzero(hi > lo)[0]
            lo, n = lo[met], (hi - lo)[met]
            total = np.cumsum(n)
            for some in np.split(np.arange(len(met)), np.unique(np.searchsorted(total, np.arange(CELLS, total[-1] if len(met) else 0, CELLS), "right"))):
                if not len(some):
                    continue
                t = np.repeat(met[some] + start, n[some])
                at = np.arange(len(t)) + np.repeat(lo[some] - np.cumsum(n[some]) + n[some], n[some])
                which, q = self.which[at], self.place[at]
                for j in range(self.k):
                    same = self.letters[which, q + j] == text[t + j]
                    if not same.all():
                        which, q, t = which[same], q[same], t[same]
                own = np.searchsorted(ends, t, "right")
                if len(ends) > 1:
                    within = t + self.k < ends[own]
                    which, q, t, own = which[within], q[within], t[within], own[within]
                # Texts count as if they were a probe's length apart, so that none of one's diagonals is another's.
                key = which * (1 << 40) + (t + own * longest - q + (1 << 30))
                key, first = np.unique(key, return_index=True)  # t ascends, so the first is the least t
                new = ~np.isin(key, seen, assume_unique=True)
                live, last = np.concatenate([seen, key[new]]), met[some[-1]] + start
                seen = live[(live & ((1 << 40) - 1)) - (1 << 30) > last + np.searchsorted(ends, last, "right") * longest - longest]
                first = first[new]
                if len(first):
                    yield which[first], q[first], t[first]


def _reach(match: np.ndarray, inside: np.ndarray, drop: int) -> tuple[np.ndarray, np.ndarray]:
    """(steps, score gain) of the earliest best point of each row, stopping after a drop of more than `drop`."""
    if match.shape[1] == 0:
        return np.zeros(len(match), np.int64), np.zeros(len(match), np.int64)
    score = np.cumsum(np.where(inside, np.where(match, 1, -1), -(drop + 2)), axis=1)
    top = np.maximum(np.maximum.accumulate(score, axis=1), 0)
    stopped = np.cumsum(top - score > drop, axis=1) > 0
    seen = np.where(stopped, -1, score)
    at = seen.argmax(axis=1)
    gain = seen[np.arange(len(seen)), at]
    return np.where(gain > 0, at + 1, 0), np.maximum(gain, 0)


def extend(
    text: np.ndarray, seeds: Seeds, which: np.ndarray, q: np.ndarray, t: np.ndarray, drop: int = DROP,
    first: np.ndarray | None = None, end: np.ndarray | None = None,
) -> tuple[np.ndarray, ...]:
    """(start, length, matches, score) of the ungapped match around each seed, from first to before end of the text; seeds of all probes at once."""
    k, n, m = seeds.k, len(text), seeds.lengths[which]
    first, end = (np.zeros(len(t), np.int64) if first is None else first)[:, None], (np.full(len(t), n) if end is None else end)[:, None]
    row = which[:, None]
    back = np.arange(1, int(q.max()) + 1)
    bq, bt = q[:, None] - back, t[:, None] - back
    inside = (bq >= 0) & (bt >= first)
    left, left_gain = _reach(seeds.letters[row, np.maximum(bq, 0)] == text[np.maximum(bt, 0)], inside, drop)
    fore = np.arange(int((m - k - q).max()))
    fq, ft = q[:, None] + k + fore, t[:, None] + k + fore
    inside = (fq < m[:, None]) & (ft < end)
    right, right_gain = _reach(seeds.letters[row, np.minimum(fq, m[:, None] - 1)] == text[np.minimum(ft, n - 1)], inside, drop)
    length, score = left + k + right, left_gain + k + right_gain
    return t - left, length, (length + score) // 2, score


def seeded_search(
    targets: DataFrame, text: str, probes: DataFrame, k: int = SEED, min_identity: float = MIN_IDENTITY,
    min_coverage: float = MIN_COVERAGE, drop: int = DROP,
) -> DataFrame:
    """targets' columns but text, probe_no, start, length, identity, score: ungapped matches, one a diagonal.

    probes: probe_no, probe, and optionally k.  On a diagonal only the seed that comes first in the target is extended.
    Probes of PROBE_LETTERS letters at most, padded to the longest, go to the executors and targets are mapped where they lie;
    more of them stay a table, and k-mers of both sides are joined.  The result is the same.
    """
    probes = probes.select("probe_no", "probe", *(["k"] if "k" in probes.columns else [F.lit(k).alias("k")])).where(F.length("probe") > 0)
    count, longest = probes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("probe")), F.lit(0))).first()
    if count * longest <= PROBE_LETTERS:
        return _seeded_map(targets, text, probes, min_identity, min_coverage, drop)
    return _seeded_join(targets, text, probes, min_identity, min_coverage, drop)


def _good(matches: np.ndarray, length: np.ndarray, probe_length: np.ndarray, min_identity: float, min_coverage: float) -> np.ndarray:
    return (matches / length >= min_identity) & (length >= probe_length * min_coverage)


def _seeded_map(targets: DataFrame, text: str, probes: DataFrame, min_identity: float, min_coverage: float, drop: int) -> DataFrame:
    rest = [c for c in targets.columns if c != text]
    shared = targets.sparkSession.sparkContext.broadcast([r.asDict() for r in probes.collect()])  # PROBE_LETTERS letters at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_k: dict[int, list[dict]] = {}
        for r in shared.value:
            by_k.setdefault(r["k"], []).append(r)
        seeds = [(Seeds([r["probe"] for r in rows], kk), np.array([r["probe_no"] for r in rows])) for kk, rows in by_k.items()]
        for b in batches:
            rows, parts, held = [], [], 0

            def found(b=b) -> pa.RecordBatch:
                kept = b.drop_columns([text]).take(pa.array(np.concatenate(rows)))  # noqa: B023
                cols = [np.concatenate(p) for p in zip(*parts, strict=True)]  # noqa: B023
                kinds = [np.int64, np.int64, np.int64, np.float64, np.int64]
                arrays = [pa.array(c.astype(t)) for c, t in zip(cols, kinds, strict=True)]
                return pa.RecordBatch.from_arrays([*kept.columns, *arrays], [*rest, "probe_no", "start", "length", "identity", "score"])

            texts = [(s or "").upper() for s in b.column(text).to_pylist()]
            sizes = np.array([len(s) + 1 for s in texts], np.int64)
            # Texts of about STRETCH letters are looked up at once, one behind the other with a letter between them.
            for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // STRETCH)) + 1):
                codes, ends = _codes("\0".join(texts[i] for i in some)), np.cumsum(sizes[some])
                begins = ends - sizes[some]
                for index, numbers in seeds:
                    size = max(1, CELLS // index.letters.shape[1])
                    for every in index.of(codes, ends):
                        for at in range(0, len(every[0]), size):
                            which, q, t = (x[at : at + size] for x in every)
                            row = np.searchsorted(ends, t, "right")
                            start, length, matches, score = extend(codes, index, which, q, t, drop, begins[row], ends[row] - 1)
                            good = _good(matches, length, index.lengths[which], min_identity, min_coverage)
                            if good.any():
                                parts.append((numbers[which[good]], (start - begins[row])[good], length[good], matches[good] / length[good], score[good]))
                                rows.append(some[row[good]])
                                held += len(rows[-1])
                                if held >= FOUND:
                                    yield found()
                                    rows, parts, held = [], [], 0
            if rows:
                yield found()

    fields = ", ".join(f"`{c}` {targets.schema[c].dataType.simpleString()}" for c in rest)
    ship(targets.sparkSession)
    return targets.mapInArrow(run, f"{fields}, probe_no long, start long, length long, identity double, score long")


def _seeded_join(targets: DataFrame, text: str, probes: DataFrame, min_identity: float, min_coverage: float, drop: int) -> DataFrame:
    """As _seeded_map by joins: k-mers meet as numbers of rows, and only what shares one fetches its letters, a probe's length of them.

    A target is known by a digest of its row; equal rows are searched once and each gets the hits.  Each of the few lengths of
    seeds is a scan of its own.
    """
    rest = [c for c in targets.columns if c != text]
    plain = lambda c: F.regexp_replace(F.upper(c), r"[^\x00-\xff]", "?")  # noqa: E731  as _codes reads letters
    keyed = targets.withColumn("_t", F.sha2(F.to_json(F.struct(*targets.columns)), 256))
    texts = keyed.select("_t", plain(F.col(text)).alias("_text")).dropDuplicates(["_t"])
    probes = probes.withColumn("probe", plain(F.col("probe")))
    longest = probes.agg(F.max(F.length("probe"))).first()[0]
    places = []
    for (k,) in sorted(probes.select("k").distinct().collect()):
        own = kmers(probes.where(F.col("k") == k).select("probe_no", F.col("probe").alias("_p")), "_p", k, at="_q", kmer="_kmer")
        own = own.groupBy("probe_no", "_kmer").agg(F.min("_q").alias("_q"))
        theirs = kmers(texts, "_text", k, at="_at", kmer="_kmer").select("_t", "_at", "_kmer")
        met = theirs.join(own, "_kmer").groupBy("_t", "probe_no", (F.col("_at") - F.col("_q")).alias("_d"))
        places.append(met.agg(F.min(F.struct("_at", "_q")).alias("_s")).select("_t", "probe_no", "_d", F.col("_s._q").alias("_q"), F.lit(k).alias("_k")))
    step = max(CHUNK, longest)
    pieces = chunked(texts, "_text", 0, longest, step).select("_t", (F.col("chunk_at") / step).cast("long").alias("_c"), "chunk")
    seeds = reduce(DataFrame.union, places).withColumn("_c", F.floor(F.greatest(F.col("_d"), F.lit(0)) / step))
    first = F.greatest(F.col("_d"), F.lit(0))
    window = F.substr(F.col("chunk"), (first - F.col("_c") * step + 1).cast("int"), F.length("probe") - (first - F.col("_d")).cast("int"))
    # Letters that a text doesn't have, before it or behind it, match nothing.
    full = F.rpad(F.concat(F.repeat(F.lit("\0"), (first - F.col("_d")).cast("int")), window), F.length("probe"), F.lit("\0"))
    lined = seeds.join(probes.select("probe_no", "probe"), "probe_no").join(pieces, ["_t", "_c"])
    lined = lined.select("_t", "probe_no", F.col("_d").cast("long").alias("_d"), F.col("_q").cast("long").alias("_q"), "_k", "probe", full.alias("window"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(at, FOUND // 100) for at in range(0, b.num_rows, FOUND // 100)):
                for k in set(part.column("_k").to_pylist()):
                    rows = part.filter(pa.compute.equal(part.column("_k"), k))
                    own = [_codes(p) for p in rows.column("probe").to_pylist()]
                    lengths = np.array([len(p) for p in own], np.int64)
                    letters = np.zeros((len(own), int(lengths.max())), np.uint8)
                    for i, p in enumerate(own):
                        letters[i, : len(p)] = p
                    ends = np.cumsum(lengths)
                    text = _codes("".join(rows.column("window").to_pylist()))
                    d, q = rows.column("_d").to_numpy(), rows.column("_q").to_numpy()
                    base = ends - lengths
                    start, length, matches, score = extend(text, SimpleNamespace(k=k, letters=letters, lengths=lengths), np.arange(len(own)), q, base + q, drop)
                    good = np.nonzero(_good(matches, length, lengths, min_identity, min_coverage))[0]
                    cols = [(start - base + d)[good], length[good], (matches / length)[good], score[good]]
                    yield pa.RecordBatch.from_arrays([*rows.select(["_t", "probe_no"]).take(pa.array(good)).columns, *map(pa.array, cols)], ["_t", "probe_no", "start", "length", "identity", "score"])

    ship(targets.sparkSession)
    hits = lined.mapInArrow(run, "_t string, probe_no long, start long, length long, identity double, score long")
    return keyed.select(*rest, "_t").join(hits, "_t").drop("_t")


def numbered(probes: DataFrame) -> DataFrame:
    """probes with probe_no: a number for each, stable for the same rows.  Probes are the small side of a search."""
    return probes.withColumn("probe_no", F.row_number().over(Window.orderBy(*probes.columns)).cast("long"))


def fuzzy_search(
    corpus: DataFrame, queries: DataFrame, min_identity: float = MIN_IDENTITY, min_coverage: float = MIN_COVERAGE, k: int = SEED
) -> DataFrame:
    """As exact_search, seeded by shared k-mers (k of PREFIX at most) and extended without gaps; upper and lower case are one."""
    probes = numbered(both_strands(queries.select("query_id", "sequence")).select("query_id", "strand", "probe"))
    hits = seeded_search(corpus.select("file", "name", "sequence"), "sequence", probes, k, min_identity, min_coverage)
    hits = hits.join(small(probes.drop("probe")), "probe_no")
    return hits.select(
        "query_id", "file", "name", "start", (F.col("start") + F.col("length") - 1).alias("end"), "strand", "length", "identity", "score",
        F.lit(None).cast("int").alias("frame"),
    )


def protein_fuzzy_search(corpus: DataFrame, peptides: DataFrame, min_identity: float = MIN_IDENTITY, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """As protein_exact_search, seeded; the seed is half the peptide, at least three residues and at most SEED."""
    seed = F.least(F.lit(SEED), F.greatest(F.lit(3), F.floor(F.length("sequence") / 2).cast("int")))
    probes = numbered(peptides.select("query_id", F.col("sequence").alias("probe"), seed.alias("k")))
    frames = six_frames(corpus.select("file", "name", "sequence"))
    hits = seeded_search(frames, "protein", probes, SEED, min_identity, min_coverage).join(small(probes.select("probe_no", "query_id")), "probe_no")
    start, end = residues_to_bases(F.col("start"), F.col("length"), F.col("frame_at"), F.col("strand"), F.col("bases"))
    return hits.select("query_id", "file", "name", start.alias("start"), end.alias("end"), "strand", "length", "identity", "score", "frame")


# ---- within mismatches


def find_with_mismatches(targets: DataFrame, queries: DataFrame, most: int = 2) -> DataFrame:
    """query_id, file, strand, start, end of windows that differ from the query in at most `most` letters.

    targets: file, sequence, circular; queries: query_id, sequence.  Circular targets are read twice around.  Texts are compared
    as bit vectors where they lie.  Those read letters beyond Latin-1 as a question mark: probes with such letters are sought
    by pieces instead, one of most + 1 of which must match exactly: pieces are joined by k-mer and only those windows compared.
    """
    probes = both_strands(queries.select("query_id", F.col("sequence").alias("query")), "query").drop("query")
    probes = probes.where(F.length("probe") > most)
    odd = F.col("probe").rlike(r"[^\x01-\xff]|\?")
    plain = scanned(targets, probes.where(~odd).select("query_id", "strand", F.col("probe").alias("sequence")), list, most)
    probes = probes.where(odd)
    # Probes with the same length of k-mer together, as a short one would have long ones found by k-mers of its length.
    probes = probes.withColumn("_k", F.least(F.lit(PREFIX), F.floor(F.length("probe") / (most + 1))).cast("int"))
    sizes = probes.groupBy("_k").agg(F.max(F.length("probe"))).collect()
    if not sizes:
        return plain
    found = [_within(targets, probes.where(F.col("_k") == k).drop("_k"), most, k, longest) for k, longest in sorted(sizes)]
    return reduce(DataFrame.union, found).distinct().union(plain)


def _within(targets: DataFrame, probes: DataFrame, most: int, k: int, longest: int) -> DataFrame:
    piece = F.floor(F.length("probe") / (most + 1)).cast("int")
    pieces = probes.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: i * piece)).alias("piece_at"))
    pieces = pieces.withColumn("_key", F.substr(F.col("probe"), F.col("piece_at") + 1, F.lit(k)))
    doubled = targets.select("file", F.length("sequence").alias("n"), F.when(F.col("circular"), F.concat("sequence", "sequence")).otherwise(F.col("sequence")).alias("text"))
    found = occurrences(doubled, "text", pieces, "_key", around=longest)
    local = F.col("_i") - F.col("piece_at")
    found = found.withColumn("start", F.col("at") - F.col("piece_at")).where((local >= 0) & (local + F.length("probe") <= F.length("chunk")))
    window = F.substr(F.col("chunk"), local + 1, F.length("probe"))
    letters = F.zip_with(F.split(window, ""), F.split("probe", ""), lambda a, b: (a != b).cast("int"))
    misses = F.aggregate(letters, F.lit(0), lambda a, x: a + x)
    found = found.where(misses <= most)
    n = F.col("n")
    return found.select(
        "query_id", "file", "strand", (F.col("start") % n).cast("long").alias("start"), ((F.col("start") + F.length("probe") - 1) % n).cast("long").alias("end")
    )


# ---- ranking


def ranked(hits: DataFrame, top: int = TOP) -> DataFrame:
    """The best hits of each query, with rank: score, identity, start; ties by file, strand, frame, end."""
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.desc("identity"), "start", "file", F.desc("strand"), F.col("frame").asc_nulls_first(), "end"
    )
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
