"""MinHash near-duplicates by an LSH forest.

Sets.  A text's distinct 4-word shingles are hashed to 64 bits; equal sets are one row in all that follows, so groups of
copies cost nothing.

Forest.  Each tree is an order: sets sorted by DEPTH min-hashes, one after the other.  Two sets of similarity s agree on
the first d with probability s ** d, so a set's most similar ones are those next to it, with the longest common
prefix.  Neighbours in an order are candidates if they share FLOOR min-hashes; in a sparse region that depth alone decides, in
a dense one the nearest take the places and the depth at which sets still meet grows with the region.  Orders are dealt out
by ranges, which split regions of any size.  A pair of similarity 0.8 shares the floor in none of 16 trees with probability
8e-8; ranges cut few neighbours apart, in other places in each tree.

Leaders.  A set that many others are copies of has more links than neighbours: of every crowded region of the first orders the sets that agree best
with its most common min-hashes are nominated, at each of LEVELS prefixes, and compared with all sets that share the floor with them
in any of the trees, so that a group of any size round one text is linked with as many comparisons as it has members.

Links.  Candidates pass on exact sizes and on a sketch, a byte of each min-hash of the forest (a pair at the threshold fails
with probability 1e-6), then are confirmed on the full sets.  First each set's next neighbours in FIRST of the orders are confirmed and linked;
then wider neighbourhoods in all orders are searched, twice, for pairs between different components only, so that a group of near
copies is linked by a few confirmations a member, not by all its pairs; every such pair is confirmed.

Defined results: null and empty texts have no set, link with nothing and keep their own id; a null doc_id counts as the
largest id; repeated rows have equal sets; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash import components

SHINGLE = 4
SIMILAR = 80  # of a hundred
TREES, DEPTH, FLOOR = 16, 8, 2
#: Neighbours that are compared in an order: next to a set, in the first orders, then between components, in all.
NEXT, FIRST, WIDE = 1, 4, (2, 32)
#: Min-hashes that a region's sets share, the sets that make it crowded, and those that it nominates, a batch of its rows.
LEVELS, CROWD, NOMINEES = (FLOOR, 6), 32, 1
#: How many of the sketch's bytes must agree: 4.75 standard deviations below the threshold.
SKETCH = TREES * DEPTH
AGREE = 81
SEED = 42
#: Shingles whose min-hashes are taken at once.
BLOCK = 1 << 13
#: Ids, and bytes of full sets, that are broadcast at most; beyond, both sides are shuffled.
BROADCAST_IDS, BROADCAST_BYTES = 4_000_000, 32 << 20
#: Rows of leaders that are broadcast at most, as many to a set as there are trees.
BROADCAST_LEADERS = 200_000
#: Links of a task when components are taken.
TASK_LINKS = 100_000

_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, TREES * DEPTH), dtype=np.uint64)
_TIMES, _PLUS = (_ODD[0] << np.uint64(1)) | np.uint64(1), _ODD[1]
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than a shingle are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    if len(h) < SHINGLE:
        whole = np.uint64(digest(b" ".join(words), SEED + 1))
        return np.array([whole])
    total = len(h) - SHINGLE + 1
    grams = np.zeros(total, np.uint64)
    for k in range(SHINGLE):
        grams = _mixed(grams + h[k : k + total] * _PLACES[k] + np.uint64(k))
    return np.unique(grams)


def signature(grams: np.ndarray) -> np.ndarray:
    """TREES * DEPTH min-hashes of 32 bits."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), BLOCK):
        part = grams[at : at + BLOCK]
        for j in range(0, TREES * DEPTH, 16):
            block = _TIMES[j : j + 16, None] * part[None, :] + _PLUS[j : j + 16, None]
            np.minimum(least[j : j + 16], block.min(1), out=least[j : j + 16])
    return (_mixed(least) >> np.uint64(32)).astype(np.uint32)


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, set (16 bytes that name the set, null if empty), n (its size), mins (its signature, packed)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 512):
            names, sizes, mins = [], [], []
            for t in b.column("text").to_pylist():
                grams = shingle_set(t)
                sizes.append(len(grams))
                names.append(hashlib.sha256(grams.tobytes()).digest()[:16] if len(grams) else None)
                mins.append(signature(grams).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(mins, pa.binary())], ["doc_id", "set", "n", "mins"])

    return common.map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, `set` binary, n long, mins binary")


def placed(reps: DataFrame, trees: int = TREES, leads: bool = False) -> DataFrame:
    """A row for each set and each of the first trees: tree, lead (the first FLOOR min-hashes), sketch, and reps' other columns.

    sketch: a byte of each min-hash of the forest, the tree's own first, then those of the trees after it: what orders equal leads.
    leads: with all trees' leads.
    """
    extra = [c for c in reps.columns if c not in ("mins",)]
    kinds = ", ".join([f"`{c}` {reps.schema[c].dataType.simpleString()}" for c in extra] + ["leads array<bigint>"] * leads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 1 << 12):
            mins = np.frombuffer(b"".join(b.column("mins").to_pylist()), np.uint32).reshape(-1, TREES, DEPTH)
            flat = (mins.reshape(len(mins), -1) & np.uint32(255)).astype(np.uint8)
            every = [pa.array(list(np.ascontiguousarray(mins[:, :, :FLOOR]).view(np.int64)[:, :, 0]), pa.list_(pa.int64()))] if leads else []
            for t in range(trees):
                big = mins[:, t, :FLOOR].astype(">u4")
                lead = np.ascontiguousarray(big).view(">i8").astype(np.int64).ravel()
                sketch = pa.array([x.tobytes() for x in np.roll(flat, -t * DEPTH, 1)], pa.binary())
                own = [*(b.column(c) for c in extra), *every]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mins), t, np.int32)), pa.array(lead), sketch, *own], ["tree", "lead", "sketch", *extra, *["leads"] * leads])

    return common.map_batches(reps.select("mins", *extra), run, f"tree int, lead long, sketch binary, {kinds}")


def orders(reps: DataFrame, trees: int = TREES) -> DataFrame:
    """placed() in the trees' orders: equal leads by the longest common prefix of all further min-hashes, however large the region."""
    return placed(reps, trees).repartitionByRange("tree", "lead", "sketch", "set").sortWithinPartitions("tree", "lead", "sketch", "set")


def _bytes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def nominated(ordered: DataFrame) -> DataFrame:
    """set of those that agree best with what is most common in a crowded region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows < CROWD:
                continue
            tree, lead, sketch = b.column("tree").to_numpy(), b.column("lead").to_numpy(), _bytes(b.column("sketch"))
            chosen = []
            for level in LEVELS:
                new = (tree[1:] != tree[:-1]) | (lead[1:] != lead[:-1]) | (sketch[1:, :level] != sketch[:-1, :level]).any(1)
                cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(tree)]])
                for k in np.flatnonzero(np.diff(cuts) >= CROWD):
                    own = sketch[cuts[k] : cuts[k + 1]]
                    usual = np.array([np.bincount(own[:, j], minlength=1).argmax() for j in range(SKETCH)], np.uint8)
                    alike = (own == usual).sum(1)
                    chosen.append(cuts[k] + np.argsort(-alike, kind="stable")[:NOMINEES])
            if chosen:
                yield pa.RecordBatch.from_arrays([b.column("set").take(pa.array(np.unique(np.concatenate(chosen))))], ["set"])

    return common.map_batches(ordered.select("tree", "lead", "sketch", "set"), run, "`set` binary").distinct()


def met(rooted: DataFrame, own: DataFrame) -> DataFrame:
    """Sets that share a lead with one of own (placed leaders, l_ before their names) of another root and a size that fits.

    A pair that shares several is made in the first such tree only, so there are no more rows than pairs.
    """
    fits = (F.col("root") != F.col("l_root")) & (100 * F.least("n", "l_n") >= SIMILAR * F.greatest("n", "l_n"))
    first = F.array_position(F.zip_with("leads", "l_leads", lambda x, y: x == y), True) == F.col("s.tree") + 1
    on = (F.col("s.tree") == F.col("l.tree")) & (F.col("s.lead") == F.col("l.lead")) & fits & first
    pairs = placed(rooted, leads=True).alias("s").join(own.alias("l"), on)
    return pairs.select(F.col("set").alias("x"), F.col("l_set").alias("y"), "sketch", "l_sketch")


def led(rooted: DataFrame, leaders: DataFrame) -> DataFrame:
    """a, b (a < b), alike: sets (set, n, mins, root) with a leader (set) of another root that may be similar."""
    own = placed(rooted.join(leaders, "set", "left_semi"), leads=True)
    own = common.written(own.select("tree", "lead", *(F.col(c).alias(f"l_{c}") for c in ("set", "n", "root", "sketch", "leads"))), "leaders")
    few = own.count() <= BROADCAST_LEADERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                alike = (_bytes(b.column("sketch")) == _bytes(b.column("l_sketch"))).sum(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(alike)], ["x", "y", "alike"]).filter(pa.array(alike >= AGREE))

    pairs = common.map_batches(met(rooted, F.broadcast(own) if few else own), run, "x binary, y binary, alike int")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "alike").where("a <> b").distinct()


def neighbours(ordered: DataFrame, width: int) -> DataFrame:
    """a, b (a < b), alike: rows at most `width` apart in an order that may be similar; if rows have a root, of different ones."""
    rooted = "root" in ordered.columns
    columns = ["tree", "lead", "n", "set", "sketch"] + ["root"] * rooted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in batches:
            table = pa.Table.from_batches([b.select(columns)])
            fresh = b.num_rows
            if tail is not None:
                table = pa.concat_tables([tail, table])
            table = table.combine_chunks()
            total = table.num_rows
            tree, lead, n = (table.column(c).to_numpy() for c in ("tree", "lead", "n"))
            sketch = _bytes(table.column("sketch"))
            names = table.column("set").combine_chunks()
            own = np.unique(np.array(table.column("root").to_pylist(), "S16"), return_inverse=True)[1] if rooted else np.arange(total)
            for w in range(1, min(width, total - 1) + 1):
                i = np.arange(max(w, total - fresh), total)
                j = i - w
                near = (tree[i] == tree[j]) & (lead[i] == lead[j]) & (own[i] != own[j])
                if not near.any():
                    if not ((tree[i] == tree[j]) & (lead[i] == lead[j])).any():
                        break  # sorted: no region reaches so far
                    continue
                i, j = i[near], j[near]
                fits = 100 * np.minimum(n[i], n[j]) >= SIMILAR * np.maximum(n[i], n[j])
                i, j = i[fits], j[fits]
                alike = (sketch[i] == sketch[j]).sum(1)
                stay = alike >= AGREE
                if stay.any():
                    x, y = names.take(pa.array(i[stay])), names.take(pa.array(j[stay]))
                    yield pa.RecordBatch.from_arrays([x, y, pa.array(alike[stay].astype(np.int32))], ["x", "y", "alike"])
            tail = table.slice(max(0, total - width))

    pairs = common.map_batches(ordered.select(columns), run, "x binary, y binary, alike int")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "alike").where("a <> b").distinct()


def full_sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """set, grams (all hashes, packed) of the wanted sets (set), from the text of one document each."""
    ids = reps.join(wanted, "set", "left_semi").select(F.col("first_id").alias("id")).distinct()
    ids = common.written(ids, "wanted-ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select("doc_id", "text").join(side, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 512):
            rows = [g for g in map(shingle_set, b.column("text").to_pylist()) if len(g)]
            names = [hashlib.sha256(g.tobytes()).digest()[:16] for g in rows]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([g.tobytes() for g in rows], pa.binary())], ["set", "grams"])

    found = common.map_batches(texts, run, "`set` binary, grams binary")
    return found.dropDuplicates(["set"]).join(wanted, "set", "left_semi")


def confirmed(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """a, b of the pairs whose full sets are similar."""
    one, other = (held.select(F.col("set").alias(c), F.col("grams").alias(f"grams_{c}")) for c in "ab")
    if (held.agg(F.sum(F.octet_length("grams"))).first()[0] or 0) <= BROADCAST_BYTES:
        one, other = F.broadcast(one), F.broadcast(other)
    both = pairs.select("a", "b").join(one, "a").join(other, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 512):
            stay = []
            for x, y in zip(b.column("grams_a"), b.column("grams_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                stay.append(100 * shared >= SIMILAR * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(stay, pa.bool_()))

    return common.map_batches(both, run, "a binary, b binary")


def _linked(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    return common.written(confirmed(pairs, common.written(full_sets(docs, reps, wanted), "full-sets")), "links")


def _joined(roots: DataFrame | None, edges: DataFrame, reps: DataFrame) -> DataFrame:
    """set, root of every set with further links: only the roots that these join are looked at, those of no link stay as they are."""
    many = edges.count()
    if roots is None:
        roots = reps.select("set", F.col("set").alias("root"))
    elif many:
        one, other = (roots.select(F.col("set").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        edges = edges.join(one, "a").join(other, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    if not many:
        return roots
    joined = components(edges, 1 + many // TASK_LINKS).select(F.col("node").alias("root"), F.col("root").alias("least"))
    return common.written(roots.join(joined, "root", "left").select("set", F.coalesce("least", "root").alias("root")), "roots")


def links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """set, root: the least set that each can reach over links."""
    ordered = orders(reps.select("set", "n", "mins"), FIRST)
    near = common.written(neighbours(ordered, NEXT), "neighbours")
    leaders = common.written(nominated(ordered), "nominated")
    roots = _joined(None, _linked(docs, reps, near), reps)
    asked = near.select("a", "b")
    for width in (None, *WIDE):
        rooted = reps.select("set", "n", "mins").join(roots, "set")
        found = neighbours(orders(rooted), width) if width else led(rooted, leaders)
        # Those already refuted are left out.
        near = common.written(found.join(asked, ["a", "b"], "left_anti"), "neighbours")
        if near.isEmpty():
            continue
        asked = asked.unionByName(near.select("a", "b"))
        roots = _joined(roots, _linked(docs, reps, near), reps)
    return roots


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    own = common.written(sets(docs), "shingle-sets")
    alone = own.where(F.col("set").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    reps = own.where(F.col("set").isNotNull()).groupBy("set").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("mins").alias("mins"))
    reps = common.written(reps, "distinct-sets")
    rooted = common.written(reps.select("set", "first_id").join(links(docs, reps), "set"), "rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_set = common.written(rooted.join(least, "root").select("set", "component_id"), "components")
    found = own.select("doc_id", "set", F.col("n").alias("n_shingles")).join(by_set, "set").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
