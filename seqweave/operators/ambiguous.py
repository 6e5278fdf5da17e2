"""Searches in which a letter of the query stands for several, with mismatches allowed, in bases or in translated frames.

No exact seed exists for such letters, so every place is compared, a word of places at a time: a text is one bit vector
for each of its letters, and a query's letter the union of those it stands for.  The places that hold a query's first
letters with at most k mismatches are a bit vector too, which each letter narrows by a shift and two operations.

Queries go to the executors in blocks of bounded size; targets are read once a block, where they lie.  Texts lie one behind
the other, so that a step of a query is one for all of them; once few places are left, their letters are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import GENETIC_CODE, rev_comp
from ..shipping import ship

#: Letters of the queries of a block.
BLOCK_LETTERS = 1 << 20
#: Places that are compared at once.
PLACES = 1 << 20
#: Letters after which the places that are left are counted; they are few if they are one in 2 ** FEW; letters between cuts of the few.
LOOK, FEW, STEP = 2, 9, 8

# The letters that a letter of a query stands for; others stand for any.
BASES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT",
    "N": "ACGT", "X": "ACGT",
}
RESIDUES = {c: c for c in "ACDEFGHIKLMNPQRSTVWYUO"} | {"B": "DN", "Z": "EQ", "J": "IL", "*": "*."}


class Text:
    """A text as bit vectors, a bit a place."""

    def __init__(self, text: np.ndarray):
        self.letters = text
        self.held: dict[str, int] = {}

    def of(self, letters: str | None) -> int | None:
        """Places that hold one of the letters; None for any letter."""
        if letters is None:
            return None
        if letters not in self.held:
            self.held[letters] = int.from_bytes(np.packbits(_fits(letters)[self.letters], bitorder="little").tobytes(), "little")
        return self.held[letters]

    def find(self, query: list[str | None], most: int) -> np.ndarray:
        """Places where the query's letters follow with at most `most` mismatches."""
        places = len(self.letters) - len(query) + 1
        if places <= 0 or not query:
            return np.zeros(0, np.int64)
        within, seen = [(1 << places) - 1] * (most + 1), 0
        for j, letters in enumerate(query):
            hit = self.of(letters)
            if hit is None:
                continue
            hit >>= j
            for k in range(most, 0, -1):
                within[k] = (within[k] & hit) | within[k - 1]
            within[0] &= hit
            seen += 1
            if not within[most]:
                return np.zeros(0, np.int64)
            if seen % LOOK == 0 and within[most].bit_count() <= places >> FEW:
                return self._counted(_ones(within[most], places), query, most)
        return _ones(within[most], places)

    def _counted(self, places: np.ndarray, query: list[str | None], most: int) -> np.ndarray:
        """Those of the places where the query fits, letter by letter."""
        misses = np.zeros(len(places), np.int64)
        for j, letters in enumerate(query):
            if letters is not None:
                misses += ~_fits(letters)[self.letters[places + j]]
            if j % STEP == STEP - 1:
                places, misses = places[misses <= most], misses[misses <= most]
        return places[misses <= most]


@cache
def _fits(letters: str) -> np.ndarray:
    """Whether each letter is one of the given ones."""
    return np.isin(np.arange(256), np.frombuffer(letters.encode("latin-1", "replace"), np.uint8))


def _ones(bits: int, places: int) -> np.ndarray:
    """The places of a vector's ones."""
    held = np.frombuffer(bits.to_bytes((places + 7) // 8, "little"), np.uint8)
    some = np.flatnonzero(held)
    byte, bit = np.nonzero(np.unpackbits(held[some, None], axis=1, bitorder="little"))
    return some[byte] * 8 + bit


def found_in(text: str | np.ndarray, queries: list[list[str | None]], most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query, places) in a text of any length, read in overlapping pieces."""
    text = np.frombuffer(text.encode("latin-1", "replace"), np.uint8) if isinstance(text, str) else text
    reach = max(map(len, queries), default=0)
    for at in range(0, max(1, len(text)), PLACES):
        piece = Text(text[at : at + PLACES + reach - 1])
        for q, letters in enumerate(queries):
            places = piece.find(letters, most)
            places = places[places < PLACES] + at
            if len(places):
                yield q, places


class Rows:
    """Texts one behind the other, each from a third place on, with a letter between them at least that they don't have."""

    def __init__(self, texts: list[str]):
        codes = [np.frombuffer(t.encode("latin-1", "replace"), np.uint8) for t in texts]
        self.lengths = np.array([len(c) for c in codes], np.int64)
        room = self.lengths // 3 * 3 + 3
        self.starts = np.cumsum(room) - room
        self.letters = np.zeros(int(room.sum()), np.uint8)
        for at, c in zip(self.starts.tolist(), codes, strict=True):
            self.letters[at : at + len(c)] = c

    def inside(self, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in it) of those places from which a row holds so many letters."""
        row = np.searchsorted(self.starts, places, "right") - 1
        own = places - self.starts[row]
        held = own + size <= self.lengths[row]
        return row[held], own[held]


def stands_for(query: str, codes: dict[str, str] | None) -> list[str | None]:
    """The letters that each letter of a query stands for; without codes itself alone."""
    return [codes.get(c) if codes else c for c in query.upper()]


_CODE = np.frombuffer(GENETIC_CODE.encode(), np.uint8)
_BASE = np.full(256, 64, np.uint8)
_BASE[np.frombuffer(b"TCAGU", np.uint8)] = [0, 1, 2, 3, 0]


def translated(text: np.ndarray, offset: int) -> np.ndarray:
    """The frame that starts at offset; codons of other letters than bases are X, a last incomplete one is left out."""
    own = _BASE[text[offset:]]
    one, two, three = (own[: len(own) // 3 * 3][i::3] for i in range(3))
    known = (one | two | three) < 64
    return np.where(known, _CODE[((one & 3) << 4) | ((two & 3) << 2) | (three & 3)], np.uint8(ord("X")))


_COMPLEMENT = str.maketrans("ACGTURYSWKMBDHVN", "TGCAAYRSWMKVHDBN")


def _blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    held, letters = [], 0
    for r in queries.toLocalIterator():
        held.append(tuple(r))
        letters += len(r[-1])
        if letters >= BLOCK_LETTERS:
            yield held
            held, letters = [], 0
    if held:
        yield held


def find_ambiguous(targets: DataFrame, queries: DataFrame, most: int = 0, ambiguous: bool = True, protein: bool = False) -> DataFrame:
    """query_id, file, strand, start, end of the places that a query fits with at most `most` mismatches, once each.

    targets: file, sequence, circular (bases); queries: query_id, sequence, bases or, with protein, residues that are sought
    in the three frames of each strand.  ambiguous: a query's letters stand for others (BASES, RESIDUES); a target's letters are
    taken as they are.  Circular targets are read twice around.  A query of bases that is its own reverse complement has one
    strand.  Null and empty texts find nothing.
    """
    own = queries.select("query_id", F.upper("sequence").alias("sequence")).where(F.length("sequence") > 0)
    probes = own.select("query_id", F.lit(1).alias("strand"), "sequence")
    if protein:
        probes = probes.unionByName(own.select("query_id", F.lit(-1).alias("strand"), "sequence"))
    else:
        back = own.select("query_id", F.lit(-1).alias("strand"), rev_comp("sequence").alias("back"), "sequence").where("back <> sequence")
        probes = probes.unionByName(back.select("query_id", "strand", F.col("back").alias("sequence")))
    codes = (RESIDUES if protein else BASES) if ambiguous else None
    upper = targets.select("file", F.upper("sequence").alias("sequence"), "circular")
    return scanned(upper, probes, lambda q: stands_for(q, codes), most, protein)


def scanned(targets: DataFrame, probes: DataFrame, letters: Callable[[str], list[str | None]], most: int, protein: bool = False) -> DataFrame:
    """As find_ambiguous, of probes (query_id, strand, sequence) in targets as they are; letters: what each letter of a probe stands for."""
    kinds = (probes.schema["query_id"].dataType.simpleString(), targets.schema["file"].dataType.simpleString())
    schema = f"query_id {kinds[0]}, file {kinds[1]}, strand int, start long, end long"
    ship(targets.sparkSession)
    out = None
    for block in _blocks(probes):
        part = _scan(targets, [(i, s, letters(q)) for i, s, q in block], most, protein, schema)
        out = part if out is None else out.unionByName(part)
    return targets.sparkSession.createDataFrame([], schema) if out is None else out.distinct()


def _scan(targets: DataFrame, block: list[tuple], most: int, protein: bool, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))
    by_strand = {s: [(i, q) for i, x, q in block if x == s] for s in (1, -1)}

    def places(texts: list[str]) -> Iterator[tuple]:
        """query_id, strand, rows, starts, ends in them."""
        size = 3 if protein else 1
        for strand, probes in by_strand.items():
            if not probes:
                continue
            rows = Rows([t.translate(_COMPLEMENT)[::-1] for t in texts] if protein and strand == -1 else texts)
            for offset in range(3) if protein else (0,):
                subject = translated(rows.letters, offset) if protein else rows.letters
                for q, at in found_in(subject, [p for _, p in probes], most):
                    many = len(probes[q][1]) * size
                    row, start = rows.inside(at * size + offset, many)
                    if protein and strand == -1:
                        start = rows.lengths[row] - start - many
                    if len(row):
                        yield probes[q][0], strand, row, start, start + many - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequences = [s or "" for s in b.column("sequence").to_pylist()]
            texts = [s * 2 if c else s for s, c in zip(sequences, b.column("circular").to_pylist(), strict=True)]
            block = np.cumsum([len(t) for t in texts]) // PLACES
            for own in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(block)) + 1):
                own = own[[len(texts[i]) > 0 for i in own]]
                if not len(own):
                    continue
                n, files = np.array([len(sequences[i]) for i in own], np.int64), b.column("file").take(pa.array(own))
                for query, strand, row, start, end in places([texts[i] for i in own]):
                    columns = ([query] * len(row), files.take(pa.array(row)), [strand] * len(row), start % n[row], end % n[row])
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, x.type) for c, x in zip(columns, fields, strict=True)], fields.names)

    return targets.select("file", "sequence", "circular").mapInArrow(run, schema)
