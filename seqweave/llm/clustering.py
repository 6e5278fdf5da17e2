"""Centroid clustering of integer vectors by dual-tree Lloyd rounds.

Vectors lie in a forest of cover trees that is built once, where the vectors lie: each block of at most BLOCK vectors has
a tree whose levels are nested nets (points of a level are further than 2 ** level apart, each point of the level below
is within that of its parent).  A node keeps its centre, its exact radius, and the number and sum of all vectors below.

A round makes a tree over the centroids and walks each cover tree against it, a level of node pairs at a time: a centroid
node is dropped for a vector node when another one is nearer to everything in it, by the triangle inequality between nodes
and by the bisecting plane between single centroids.  A vector node that is left with one centroid adds its sum and count
as a whole; single vectors are compared with the centroids that are left, in exact integers.  Only k sums leave a round.

Defined results: vectors that are null, of another length, or with a null or non-finite component, or one whose integer is
beyond LIMIT (whose distances a long couldn't hold), are not kept; repeated rows are vectors of their own; a null vec_id comes
last among the first centroids, ties among them go by the components; fewer vectors than centroids give as many centroids
as vectors; no vectors give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSIONS = 64
CENTROIDS = 16
ROUNDS = 3
#: Vectors of a tree: their distances to each other are a matrix of 32 MB.
BLOCK = 2048
#: Integers below it have exact distances, as doubles up to SMALL and as longs beyond.
LIMIT, SMALL = 1 << 27, 1 << 22
#: Bounds are widened by it, so that rounding never drops a tie.
SLACK = 1e-9


def integers(embedding: Column, dimensions: int, scale: int = 64) -> Column:
    """floor(scale * x) of each component, or null for vectors that aren't kept."""
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    fits = F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < F.lit(float(LIMIT)))), F.lit(False))
    return F.when((F.size(embedding) == dimensions) & fits, whole)


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, point (array of long) of the vectors that are kept."""
    rows = vectors.select("vec_id", integers(F.col("embedding"), dimensions).alias("point"))
    return rows.where(F.col("point").isNotNull())


# Trees --------------------------------------------------------------------------------------------------------------


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a to all rows of b, as long."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < SMALL:
        x, y = a.astype(np.float64), b.astype(np.float64)
        d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
        return np.rint(d).astype(np.int64)
    return np.stack([paired(a, np.broadcast_to(row, a.shape)) for row in b], 1)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of a to the same rows of b."""
    d = a.astype(np.int64) - b
    return np.einsum("ij,ij->i", d, d)


def cover_tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """A cover tree over the rows of points, as arrays by node, parents before children.

    centre: the row; radius: of all rows below; first, last: its children's nodes; begin, end: its rows in `order`.
    A node without children is one row.
    """
    n = len(points)
    d = squared(points, points)
    # Farthest-first order: each point with its distance to those before, so that every prefix is a net.
    reach, order, insert = d[0].copy(), [0], [np.inf]
    reach[0] = -1
    for _ in range(n - 1):
        p = int(reach.argmax())
        order.append(p)
        insert.append(float(max(reach[p], 0)))
        np.minimum(reach, d[p], out=reach)
        reach[p] = -1
    insert = np.sqrt(np.array(insert))
    rank = np.array(order)
    # Levels: the prefix of points further apart than 2 ** level; a point joins at one level and stays in all below.
    top = 0 if n == 1 else int(np.floor(np.log2(max(insert[1], 0.5)))) + 1
    bottom = -1  # different integer points are at least 1 apart, equal ones join below all levels
    centre, parent, level_nodes = [0], [-1], {0: 0}
    sizes = [1]
    for level in range(top - 1, bottom - 1, -1):
        upto = int((insert > 2.0**level).sum()) if level > bottom else n
        if upto == sizes[-1]:
            continue
        above = rank[: sizes[-1]]
        members = rank[:upto]
        near = above[d[np.ix_(members, above)].argmin(1)]
        near[: sizes[-1]] = above  # a point is its own parent
        groups: dict[int, list[int]] = {}
        for m, p in zip(members.tolist(), near.tolist(), strict=True):
            groups.setdefault(p, []).append(m)
        grown = {}
        for p, own in groups.items():
            if len(own) == 1:
                grown[p] = level_nodes[p]  # unchanged: no new node
                continue
            for m in own:
                grown[m] = len(centre)
                centre.append(m)
                parent.append(level_nodes[p])
        level_nodes = grown
        sizes.append(upto)
    centre, parent = np.array(centre), np.array(parent)
    return _laid_out(points, d, centre, parent)


def _laid_out(points: np.ndarray, d: np.ndarray, centre: np.ndarray, parent: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes numbered so that children are next to each other, rows ordered so that a node's rows are a range."""
    nodes = len(centre)
    children: list[list[int]] = [[] for _ in range(nodes)]
    for i in range(1, nodes):
        children[parent[i]].append(i)
    numbered, first, last = [0], np.zeros(nodes, np.int32), np.zeros(nodes, np.int32)
    at = 0
    while at < len(numbered):  # breadth first
        own = children[numbered[at]]
        first[at] = len(numbered)
        numbered.extend(own)
        last[at] = len(numbered)
        at += 1
    begin, end, order = np.zeros(nodes, np.int32), np.zeros(nodes, np.int32), []
    stack = [(0, False)]
    while stack:
        node, left = stack.pop()
        if left:
            end[node] = len(order)
            continue
        begin[node] = len(order)
        if first[node] == last[node]:
            order.append(int(centre[numbered[node]]))
            end[node] = len(order)
        else:
            stack.append((node, True))
            stack.extend((c, False) for c in range(last[node] - 1, first[node] - 1, -1))
    order = np.array(order, np.int32)
    c = centre[np.array(numbered)]
    radius = np.array([np.sqrt(float(d[c[i], order[begin[i] : end[i]]].max())) for i in range(nodes)])
    return {"centre": c.astype(np.int32), "radius": radius, "first": first, "last": last, "begin": begin, "end": end, "order": order}


# Walks --------------------------------------------------------------------------------------------------------------


def nearest(points: np.ndarray, tree: dict[str, np.ndarray], centroids: np.ndarray, over: dict[str, np.ndarray], seen: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their centroid): nodes whose rows together are all rows, each with the nearest centroid of all of its rows.

    points: in the order of the tree's rows' numbers; over: a tree over the centroids.
    """
    count = len(centroids)
    single = over["first"] == over["last"]
    apart = np.sqrt(squared(centroids, centroids).astype(np.float64))
    done_nodes, done_best = [], []
    q, r = np.zeros(1, np.int32), np.zeros(1, np.int32)  # pairs of a vector node and a centroid node, sorted by q
    while len(q):
        exact = paired(points[tree["centre"][q]], centroids[over["centre"][r]])
        if seen is not None:
            seen["pairs"] = seen.get("pairs", 0) + len(q)
        dist = np.sqrt(exact.astype(np.float64))
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        which = np.cumsum(np.r_[False, q[1:] != q[:-1]])
        # Triangle inequality: the farthest that the best centroid node's nearest centroid can be.
        wide = tree["radius"][q] + over["radius"][r]
        upper = np.minimum.reduceat(dist + wide, starts)[which]
        stay = dist - wide <= upper * (1 + SLACK) + SLACK
        # Bisecting plane: against the single centroid that is nearest to the node's centre.
        alone = single[r]
        key = np.where(alone, exact, np.iinfo(np.int64).max)
        least = np.minimum.reduceat(key, starts)
        number = np.where(alone & (key == least[which]), over["centre"][r], count)
        best = np.minimum.reduceat(number, starts)
        has = best[which] < count
        lead = np.where(has, best[which], 0)
        gap = exact - np.where(has, least[which], 0)
        room = 2 * tree["radius"][q] * apart[lead, over["centre"][r]]
        beaten = alone & has & (gap > room * (1 + SLACK) + SLACK)
        # Of equal centroids the smaller number has all.
        beaten |= alone & has & (over["centre"][r] > lead) & (apart[lead, over["centre"][r]] == 0)
        leaf = tree["first"][q] == tree["last"][q]
        # A single vector against single centroids: exact, ties to the smaller number.
        beaten |= leaf & alone & has & ((gap > 0) | (over["centre"][r] > lead))
        stay &= ~beaten
        q, r, which = q[stay], r[stay], which[stay]
        left = np.bincount(which, minlength=len(starts))[which]
        found = (left == 1) & single[r]
        done_nodes.append(q[found])
        done_best.append(over["centre"][r[found]])
        q, r = q[~found], r[~found]
        # Descend: both sides where both have children, so that the walk is as deep as the deeper tree.
        q, r = _opened(q, r, tree, over)
    nodes, best = np.concatenate(done_nodes), np.concatenate(done_best)
    return nodes, best


def _opened(q: np.ndarray, r: np.ndarray, tree: dict[str, np.ndarray], over: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    for by, pick in ((over, 1), (tree, 0)):
        at = r if pick else q
        own = by["last"][at] - by["first"][at]
        many = np.maximum(own, 1)
        source = np.repeat(np.arange(len(at)), many)
        step = np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many)
        opened = np.where(own[source] > 0, by["first"][at[source]] + step, at[source]).astype(np.int32)
        q, r = (q[source], opened) if pick else (opened, r[source])
    sort = np.lexsort((r, q))
    return q[sort], r[sort]


# Jobs ---------------------------------------------------------------------------------------------------------------

_TREE = {"centre": np.int32, "radius": np.float64, "first": np.int32, "last": np.int32, "begin": np.int32, "end": np.int32}


def forest(points: DataFrame, dimensions: int, block: int = BLOCK) -> DataFrame:
    """A row a cover tree: ids, points (integers in the tree's order, packed) and the tree's arrays, packed."""
    kind = points.schema["vec_id"].dataType.simpleString()

    def planted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        rows = whole.column("point").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
        tree = cover_tree(rows)
        ids = whole.column("vec_id").combine_chunks().take(pa.array(tree["order"]))
        at = np.empty(len(rows), np.int32)
        at[tree["order"]] = np.arange(len(rows), dtype=np.int32)
        tree["centre"] = at[tree["centre"]]
        packed = [tree[k].astype(t).tobytes() for k, t in _TREE.items()]
        id_lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        arrays = [id_lists, pa.array([rows[tree["order"]].astype(np.int32).tobytes()], pa.binary()), *(pa.array([p], pa.binary()) for p in packed)]
        return pa.RecordBatch.from_arrays(arrays, ["ids", "points", *_TREE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, block - rows)
                held.append(part)
                rows, at = rows + part.num_rows, at + part.num_rows
                if rows == block:
                    yield planted(held)
                    held, rows = [], 0
        if held:
            yield planted(held)

    fields = ", ".join(f"`{k}` binary" for k in _TREE)
    return common.map_batches(points, run, f"ids array<{kind}>, points binary, {fields}")


def _unpacked(row: dict, dimensions: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    tree = {k: np.frombuffer(row[k], t) for k, t in _TREE.items()}
    return np.frombuffer(row["points"], np.int32).reshape(-1, dimensions).astype(np.int64), tree


def _over(centroids: np.ndarray) -> dict[str, np.ndarray]:
    return cover_tree(centroids)


def sums(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """By centroid: number and componentwise sum of its vectors; k rows of sums come to the driver."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over, total, count = _over(centroids), np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                points, tree = _unpacked({k: b.column(k)[i].as_py() for k in ("points", *_TREE)}, dimensions)
                nodes, best = nearest(points, tree, centroids, over)
                upto = np.vstack([np.zeros((1, dimensions), np.int64), np.cumsum(points, 0)])
                np.add.at(total, best, upto[tree["end"][nodes]] - upto[tree["begin"][nodes]])
                np.add.at(count, best, tree["end"][nodes] - tree["begin"][nodes])
        k = np.flatnonzero(count)
        if len(k):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(k, dimensions)), pa.array(np.tile(np.arange(dimensions), len(k))), pa.array(total[k].ravel()), pa.array(np.repeat(count[k], dimensions))],
                ["cluster", "i", "total", "n"],
            )

    parts = common.map_batches(trees.select("points", *_TREE), run, "cluster long, i long, total long, n long")
    whole = "decimal(38,0)"
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("cluster", "i").agg(F.sum(F.col("total").cast(whole)).alias("total"), F.sum("n").alias("n")).collect():
        found.setdefault(r.cluster, (r.n, [0] * dimensions))[1][r.i] = int(r.total)
    return found


def first_centroids(points: DataFrame, k: int, seed: str = "1") -> np.ndarray:
    """The k vectors with the smallest hashes of `seed:vec_id`, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.orderBy(key.asc_nulls_last(), "point").limit(k).select("point").collect()
    return np.array([r.point for r in rows], np.int64)


def lloyd(points: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every row; the centroids after all rounds)."""
    trees = common.written(forest(points, dimensions, block), "cover-trees")
    centroids = first_centroids(points, k)
    kind = points.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long"
    if not len(centroids):
        return points.sparkSession.createDataFrame([], schema), centroids
    for _ in range(rounds):
        moved = centroids.copy()
        for c, (n, total) in sums(trees, centroids).items():
            moved[c] = [t // n for t in total]
        centroids = moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = _over(centroids)
        for b in batches:
            for i in range(b.num_rows):
                points, tree = _unpacked({x: b.column(x)[i].as_py() for x in ("points", *_TREE)}, dimensions)
                nodes, best = nearest(points, tree, centroids, over)
                sort = np.argsort(tree["begin"][nodes])
                nodes, best = nodes[sort], best[sort]
                cluster = np.repeat(best, tree["end"][nodes] - tree["begin"][nodes])
                distance = paired(points, centroids[cluster])
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1).flatten(), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return common.written(common.map_batches(trees, run, schema), "clusters"), centroids


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept."""
    rows, centroids = lloyd(kept(vectors, dimensions), k, rounds, dimensions)
    whole = F.sum(F.col("distance").cast("decimal(38,0)")).cast("long")
    totals = {r.cluster: r.total for r in rows.groupBy("cluster").agg(whole.alias("total")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()] or [""]
    at = F.col("cluster") + 1
    of = [totals.get(c, 0) for c in range(len(digest))]
    return rows.select(
        "vec_id", "cluster", "distance", F.element_at(F.lit(of).cast("array<long>"), at).alias("cluster_inertia"),
        F.lit(sum(of)).cast("long").alias("inertia"), F.element_at(F.lit(digest), at).alias("centroid_sha256"),
    )
