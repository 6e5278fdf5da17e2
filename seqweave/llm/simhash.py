"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints.  A text's 3-word shingles are hashed (XXH64, seed 42) and each of 64 bits is set where over half of the
hashes set it.

Search.  Bits that are correlated over all fingerprints go to one partition, so that the partitions are nearly
independent.  Two fingerprints within TAU bits must, for thresholds t_i that sum to TAU - m + 1, differ in at most t_i
bits in some partition i (t_i = -1 skips a partition).  For each fingerprint a dynamic programme allots the thresholds
that cost the least, by the number of fingerprints that hold each value of each partition.  A value that very many
fingerprints share is so left alone by its own members, which probe other partitions.  The probes are joined with the
fingerprints' own partition values and every candidate is verified on all 64 bits inside the join.

Components of the links come from alternating large-star and small-star steps; only links take part.

Equal fingerprints are one row in all of this, so groups of copies cost nothing.

Defined results: null and empty texts have fingerprint zero and link like any other; a null doc_id counts as the
largest id; repeated rows are equal rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TAU = 3
SHINGLE = 3
SEED = 42
BITS = 64
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Partitions by the number of fingerprints: the fewer, the longer their values and the fewer candidates by chance.
PARTITIONS = ((1 << 23, 4), (1 << 30, 3), (1 << 62, 2))
#: Bits of the longest value that is counted exactly; longer values are estimated from halves as if independent.
COUNTED = 16
#: What one more probe costs, in candidates.
PROBE_COST = 1.0


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    counts = np.zeros(BITS, np.int64)
    total = n - SHINGLE + 1
    for at in range(0, total, BLOCK):
        upto = min(total, at + BLOCK)
        pairs = zip(starts[at:upto].tolist(), ends[at + SHINGLE - 1 : upto + SHINGLE - 1].tolist(), strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in pairs], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return common.map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_partitions(fps: DataFrame, m: int) -> list[list[int]]:
    """The 64 bits in m groups of equal size, correlated bits together, from counts over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        rows = 0
        for b in common.slices(batches, 1 << 14):
            x = _bits(b.column("fp").to_numpy(zero_copy_only=False)).astype(np.float32)
            total += (x.T @ x).astype(np.int64)
            rows += len(x)
        if rows:
            i, j = np.triu_indices(BITS)
            cols = [pa.array(a.astype(np.int64)) for a in (i, j, total[i, j])] + [pa.array(np.full(len(i), rows, np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["i", "j", "n", "rows"])

    sums = common.map_batches(fps.select("fp"), run, "i long, j long, n long, rows long")
    sums = sums.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))
    both = np.zeros((BITS, BITS))
    rows = 1.0
    for r in sums.toLocalIterator():  # 2,080 rows at most
        both[r.i, r.j] = both[r.j, r.i] = r.n
        rows = float(r.rows)
    p = np.diag(both) / rows
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    linked = np.abs(both / rows - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(linked, 0)
    left, groups = set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        start = max(left, key=lambda b: (linked[b, sorted(left)].max(), -b))
        group = [start]
        left.discard(start)
        while len(group) < width:
            best = max(sorted(left), key=lambda b: linked[b, group].mean())
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def part_value(fps: np.ndarray, group: list[int]) -> np.ndarray:
    u = fps.astype(np.int64).view(np.uint64)
    out = np.zeros(len(u), np.int64)
    for k, bit in enumerate(group):
        out |= (((u >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)) << k
    return out


def shells(counts: np.ndarray, width: int) -> np.ndarray:
    """[d, v]: how many fingerprints hold a value that differs from v in d bits, d up to TAU."""
    out = np.zeros((TAU + 1, len(counts)), np.float64)
    out[0] = counts
    index = np.arange(len(counts))
    for bit in range(width):
        flipped = out[:, index ^ (1 << bit)]
        out[1:] += flipped[:-1]
    return out


def estimates(blocks: list[tuple[list[int], np.ndarray]], fps: np.ndarray) -> np.ndarray:
    """[t + 1, q]: candidates that threshold t brings fingerprint q in a partition; row 0 (skipped) is zero.

    blocks: the partition's counted blocks of bits, each with its shells; one block is exact, two are taken as independent.
    """
    total = None
    for group, shell in blocks:
        own = shell[:, part_value(fps, group)]
        if total is None:
            total = own
        else:
            share = own / max(1.0, shell[0].sum())
            total = np.array([sum(total[e] * share[d - e] for e in range(d + 1)) for d in range(TAU + 1)])
    return np.vstack([np.zeros(len(fps)), np.cumsum(total, 0)])


def counted_blocks(group: list[int]) -> list[list[int]]:
    if len(group) <= COUNTED:
        return [group]
    half = -(-len(group) // 2)
    return [group[:half], group[half:]]


def masks(width: int, upto: int) -> list[np.ndarray]:
    """[d]: all masks of d bits."""
    single = [1 << k for k in range(width)]
    out = [np.zeros(1, np.int64)]
    for d in range(1, upto + 1):
        prev = out[-1]
        grown = [p | s for p in prev.tolist() for s in single if s > p]
        out.append(np.array(grown, np.int64))
    return out


def allot(costs: list[np.ndarray], need: int) -> np.ndarray:
    """Thresholds (rows: queries, columns: partitions) that sum to need at the least cost.

    costs[i][t + 1, q]: what threshold t in partition i costs query q.
    """
    m, n = len(costs), costs[0].shape[1]
    levels = costs[0].shape[0]
    total = need + m  # in units of t + 1
    best = np.full((total + 1, n), np.inf)
    best[0] = 0
    picks = []
    for c in costs:
        grown = np.full((total + 1, n), np.inf)
        pick = np.zeros((total + 1, n), np.int8)
        for t in range(min(levels, total + 1)):
            trial = best[: total + 1 - t] + c[t]
            better = trial < grown[t:]
            grown[t:] = np.where(better, trial, grown[t:])
            pick[t:] = np.where(better, t, pick[t:])
        best = grown
        picks.append(pick)
    out = np.zeros((n, m), np.int64)
    at = np.full(n, total)
    rows = np.arange(n)
    for i in range(m - 1, -1, -1):
        out[:, i] = picks[i][at, rows]
        at = at - out[:, i]
    return out - 1


def links(reps: DataFrame, groups: list[list[int]]) -> DataFrame:
    """a, b (a < b): all pairs of distinct fingerprints within TAU bits."""
    m = len(groups)
    need = TAU - m + 1

    def values(parts: list[list[int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fps = b.column("fp").to_numpy(zero_copy_only=False)
                for i, g in enumerate(parts):
                    cols = [pa.array(np.full(len(fps), i, np.int32)), pa.array(part_value(fps, g)), pa.array(fps)]
                    yield pa.RecordBatch.from_arrays(cols, ["part", "value", "fp"])

        return run

    held = common.map_batches(reps.select("fp"), values(groups), "part int, value long, fp long")
    blocks = [(i, g) for i, group in enumerate(groups) for g in counted_blocks(group)]
    # A histogram of fixed size, however many documents: at most 4 * 2 ** 16 rows.
    table = common.map_batches(reps.select("fp"), values([g for _, g in blocks]), "part int, value long, fp long")
    table = table.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).toArrow()
    part, value, n = (table.column(c).to_numpy() for c in ("part", "value", "n"))
    seen = []
    for k, (_, g) in enumerate(blocks):
        counts = np.zeros(1 << len(g), np.float32)
        counts[value[part == k]] = n[part == k]
        seen.append(counts)
    shared = reps.sparkSession.sparkContext.broadcast(seen)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [[(g, shells(c, len(g))) for (k, g), c in zip(blocks, shared.value, strict=True) if k == i] for i in range(m)]
        exact = [c[0][1][0] if len(c) == 1 else None for c in known]
        flips = [masks(len(g), max(need, 0) + m - 1) for g in groups]
        price = [PROBE_COST * np.cumsum([0] + [len(x) for x in f])[:, None] for f in flips]
        for b in common.slices(batches, 1 << 13):
            fps = b.column("fp").to_numpy(zero_copy_only=False)
            own = [part_value(fps, g) for g in groups]
            t = allot([estimates(k, fps)[: len(c)] + c for k, c in zip(known, price, strict=True)], need)
            for i in range(m):
                for d, flip in enumerate(flips[i]):
                    rows = np.nonzero(t[:, i] >= d)[0]
                    for at in range(0, len(flip) if len(rows) else 0, 64):
                        mask = flip[at : at + 64]
                        near, who = (own[i][rows, None] ^ mask[None, :]).ravel(), np.repeat(fps[rows], len(mask))
                        if exact[i] is not None:
                            held_by = exact[i][near] > 0
                            near, who = near[held_by], who[held_by]
                        cols = [pa.array(np.full(len(near), i, np.int32)), pa.array(near), pa.array(who)]
                        yield pa.RecordBatch.from_arrays(cols, ["part", "value", "probe"])

    asked = common.map_batches(reps.select("fp"), probes, "part int, value long, probe long")
    close = (F.col("probe") < F.col("fp")) & (F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= TAU)
    found = asked.alias("p").join(
        held.alias("h"), (F.col("p.part") == F.col("h.part")) & (F.col("p.value") == F.col("h.value")) & close
    )
    return found.select(F.col("probe").alias("a"), F.col("fp").alias("b")).distinct()


def forests(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) that join the same: in each task, every node but the least of those that the task's edges join, and that least one."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches) or [pa.RecordBatch.from_pydict({"a": [], "b": []})])
        if not held.num_rows:
            return
        both = pa.chunked_array([*held.column("a").chunks, *held.column("b").chunks]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(both.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        a, b = np.split(rank[both.indices.to_numpy()], 2)
        least = np.arange(len(order))
        while True:
            x, y = least[a], least[b]
            if (x == y).all():
                break
            np.minimum.at(least, x, np.minimum(x, y))
            np.minimum.at(least, y, np.minimum(x, y))
            while (least != (onward := least[least])).any():
                least = onward
        names, up = both.dictionary.take(pa.array(order)), np.flatnonzero(least != np.arange(len(order)))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(up)), names.take(pa.array(least[up]))], ["a", "b"])

    return common.map_batches(edges, run, f"a {kind}, b {kind}")


def starred(edges: DataFrame) -> bool:
    """Whether every node a has one b, which is no a itself: then nothing would change any more."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1))).groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """node, root for every node of edges (a, b) but the roots: alternating large-star and small-star until all are stars.

    tasks: so many write each shuffle, as a round has several, and a few edges in many partitions each are mostly empty files;
    each of them first joins what its own edges join, which leaves fewer rounds, or none.
    """
    few = (lambda df: df.coalesce(tasks)) if tasks else (lambda df: df)
    edges = few(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    edges = common.checkpoint(few((forests(edges) if tasks else edges).distinct()))
    while not starred(edges):
        both = few(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = few(few(large).distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = common.checkpoint(few(few(small.union(lowest.select("a", F.col("m").alias("b")))).distinct()))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id of every row.

    partitions: groups of bits, 2 to 4; by default as PARTITIONS has them.  Links are the same for any number.
    """
    own = common.written(fingerprints(docs), "fingerprints")
    reps = common.written(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    many = reps.count()
    if many == 0:
        return own.select("doc_id", F.lit("").alias("fingerprint"), F.col("doc_id").alias("component_id"))
    m = partitions or next(m for upto, m in PARTITIONS if many <= upto)
    joined = components(links(reps, bit_partitions(reps, m)))
    tree = joined.union(joined.select("root", "root")).distinct().withColumnRenamed("node", "fp")
    rooted = reps.join(tree, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = common.written(rooted.join(smallest, "root").select("fp", "component_id"), "components")
    out = own.join(by_fp, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the smallest id of their component, with their columns.

    Of rows with one doc_id and several texts those stay whose own component has no smaller id.
    """
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    found = common.written(near_duplicates(docs).select(F.col("doc_id").alias("__sw_id"), "fingerprint", stays.alias("__sw_stays")), "near-duplicates")
    ids = found.groupBy("__sw_id").agg(F.bool_and("__sw_stays").alias("__sw_all"), F.bool_or("__sw_stays").alias("__sw_any")).where("__sw_any")
    same = F.col("doc_id").eqNullSafe(F.col("__sw_id"))
    joined = docs.join(ids, same)
    whole = joined.where("__sw_all").select(*docs.columns)
    mixed = ids.where("not __sw_all").select("__sw_id")
    if mixed.limit(1).count() == 0:
        return whole
    # Rows of one id that share no fate are told by their texts' fingerprints.
    some = _with_fingerprints(docs.join(mixed, same, "left_semi")).withColumn("__sw_hex", F.lower(F.lpad(F.hex("__sw_fp"), 16, "0")))
    kept = found.where("__sw_stays")
    return whole.unionByName(some.join(kept, same & (F.col("__sw_hex") == F.col("fingerprint")), "left_semi").select(*docs.columns))


def _with_fingerprints(docs: DataFrame) -> DataFrame:
    """docs with __sw_fp, the text's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], [*b.schema.names, "__sw_fp"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return common.map_batches(docs, run, f"{fields}, __sw_fp long")
