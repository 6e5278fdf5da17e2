"""Centroid clustering, ranked lexical search and the LSH forest against brute force, on hostile rows, ties and hot groups."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweave.llm import clustering, lexical, lsh_forest, simhash

from .conftest import SCHEMA, hostile_rows


def brute_lloyd(rows, k, rounds):
    """rows: (vec_id, integers)."""
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [list(r[1]) for r in sorted(rows, key=key)[:k]]
    near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, p in rows:
            groups[near(p)[1]].append(p)
        for c, own in groups.items():
            centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *reversed(near(p))) for i, p in rows]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found)


def vectors(rng, n):
    rows = [(i, [rng.choice([-0.5, 0.25, rng.uniform(-1, 1)]) for _ in range(64)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(n // 2)] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (None, rows[4][1])]
    return rows


def test_clustering_matches_brute_force(spark):
    rows = vectors(random.Random(1), 60)
    bad = [(500, None), (501, []), (502, [0.1] * 63), (503, [0.1] * 63 + [None]), (504, [float("nan")] * 64), (505, [float("inf")] + [0.0] * 63), (506, [1e30] * 64)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, cluster int, distance string")
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    for parts in (1, 5):
        got = Counter(map(tuple, clustering.cluster(df.repartition(parts)).collect()))
        assert got == brute_lloyd(kept, 16, 3)
    few = df.where("vec_id IN (3, 4)")
    assert Counter(map(tuple, clustering.cluster(few).collect())) == brute_lloyd([r for r in kept if r[0] in (3, 4)], 16, 3)
    assert clustering.cluster(df.where("vec_id >= 500 AND vec_id < 600")).count() == 0 and clustering.cluster(df.limit(0)).count() == 0


@pytest.mark.parametrize("n, dimensions, k, size", [(1, 3, 1, 5), (300, 2, 7, 30), (400, 3, 16, 2), (200, 4, 5, 1 << 26), (700, 1, 3, 1000)])
def test_dual_trees_give_every_row_its_nearest(n, dimensions, k, size):
    rng = np.random.default_rng(n)
    points = rng.integers(-size, size, (n, dimensions))
    points[: n // 3] = points[0]
    tree = clustering.cover_tree(points)
    assert sorted(tree["order"].tolist()) == list(range(n))
    for i in range(len(tree["centre"])):  # a node's rows are within its radius, children within their parent's rows
        own = tree["order"][tree["begin"][i] : tree["end"][i]]
        assert np.sqrt(clustering.squared(points[own], points[[tree["centre"][i]]]).max()) <= tree["radius"][i] + 1e-9
        assert all(tree["begin"][i] <= tree["begin"][c] and tree["end"][c] <= tree["end"][i] for c in range(tree["first"][i], tree["last"][i]))
    at = np.argsort(tree["order"])
    tree["centre"] = at[tree["centre"]]
    rows, centroids = points[tree["order"]], points[rng.choice(n, min(n, k))]
    seen = {}
    nodes, best = clustering.nearest(rows, tree, centroids, clustering.cover_tree(centroids), seen)
    got = np.full(n, -1)
    for node, c in zip(nodes, best, strict=True):
        assert (got[tree["begin"][node] : tree["end"][node]] == -1).all()
        got[tree["begin"][node] : tree["end"][node]] = c
    want = ((rows[:, None, :] - centroids[None]) ** 2).sum(2).argmin(1)
    assert (got == want).all()
    if dimensions <= 2 and n >= 300:
        assert seen["pairs"] < n * len(centroids) / 2  # pruned


def brute_search(docs, items, top):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, b) for i, b in bags if b]
    documents, length, df = len(held), sum(sum(b.values()) for _, b in held), Counter(w for _, b in held for w in b)
    out = Counter()
    for item, text in items:
        scored = []
        for i, b in held:
            m = 10 + (90 * sum(b.values()) * documents) // length
            score = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(words(text)) if b[t])
            if score > 0:
                scored.append((-score, i is None, i, score))
        out.update((item, rank + 1, i, score) for rank, (_, _, i, score) in enumerate(sorted(scored)[:top]))
    return out


def test_search_matches_brute_force(spark, hostile, nothing, monkeypatch):
    rng = random.Random(3)
    base = [(r[0], r[1]) for r in hostile_rows()]
    more = [(100 + i, " ".join(rng.choice("alpha Beta gamma x1 漢字 ÉÀ zeta-eta one TWO".split()) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    more += [(300 + i, "alpha beta beta") for i in range(40)]
    items = [(1, "ALPHA beta; gamma"), (2, "漢字"), (3, "é ß"), (4, None), (5, "nowhere found"), (6, ""), (7, "one one TWO two"), (7, "x1 zeta"), (None, "alpha"), (9, "the alpha beta gamma delta omega w1 x1")]
    docs = hostile.select("doc_id", "text", "key", "score", "words").unionByName(spark.createDataFrame([(*d, "k", 0.0, "w") for d in more], "doc_id long, text string, key string, score double, words string"))
    queries = spark.createDataFrame([(*x, 1, 2) for x in items], "item_id long, text string, rank int, doc_id long")
    want = brute_search(base + more, items, 10)
    assert Counter(map(tuple, lexical.rank(docs.repartition(3), queries).collect())) == want
    assert Counter(map(tuple, lexical.rank(docs, queries, top=3).collect())) == brute_search(base + more, items, 3)
    assert lexical.rank(nothing, queries).count() == 0 and lexical.rank(docs, queries.limit(0)).count() == 0
    monkeypatch.setattr(lexical, "BLOCK_LETTERS", 10)  # a block a query or two
    assert Counter(map(tuple, lexical.rank(docs, queries).collect())) == want


def test_impacts_are_exact_and_bytes_bound_them():
    tf, n = np.array([1, 2, 7, 1 << 30, 5]), np.array([1, 50, 10**6, 1 << 40, 3])
    for documents, length in ((3, 10), (10**9, 10**12)):
        got = lexical.impacts(tf, n, documents, length)
        m = [10 + 90 * int(x) * documents // length for x in n]
        assert got.tolist() == [10**9 * int(t) // (1000 * int(t) + 8 * x) for t, x in zip(tf, m, strict=True)]
        byte = -(-got // lexical.STEP)
        assert (byte <= 255).all() and (byte * lexical.STEP >= got).all() and (byte * lexical.STEP - got < lexical.STEP).all()


def brute_near(rows):
    """doc_id, n_shingles, component_id, kept; all pairs of distinct sets are compared."""
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()

    sets = [(i, grams(t)) for i, t in rows]
    distinct = sorted({s for _, s in sets if s}, key=lambda s: sorted(s))
    root = {s: s for s in distinct}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for x, a in enumerate(distinct):
        for b in distinct[:x]:
            if 100 * len(a & b) >= 80 * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for i, s in sets:
        if s and i is not None:
            least[find(s)] = min(least.get(find(s), i), i)
    of = [(i, s, least.get(find(s)) if s else i) for i, s in sets]
    return Counter((i, len(s), c, i == c) for i, s, c in of)


def test_forest_matches_brute_force(spark, hostile, nothing):
    rows = [(r[0], r[1]) for r in hostile_rows()]
    assert Counter(map(tuple, lsh_forest.near_duplicates(hostile).collect())) == brute_near(rows)
    out = lsh_forest.near_duplicates(nothing)
    assert out.count() == 0 and out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert "key" in SCHEMA  # columns that clash with nothing of the result are passed over


def test_forest_links_a_hot_group_whole(spark):
    """Near copies of one text at, above and below the threshold, chains, and a passage that many unlike texts share."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 1, 2, 3, 4, 6])):
            w[at] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    drift = list(base)
    for i in range(40):
        drift[rng.randrange(120)] = f"d{i}"
        rows.append((1000 + i, " ".join(drift).upper()))
    rows += [(2000 + i, " ".join(base[:40] + [f"u{rng.randrange(10**6)}" for _ in range(60)])) for i in range(60)]
    got = Counter(map(tuple, lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()))
    assert got == brute_near(rows)


def test_forest_links_all_copies_of_one_text(spark):
    """Copies are similar to the text they come from, not to each other: it has more links than neighbours in all orders."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for d in range(1, 1601):
        words = list(base)
        for k in rng.sample(range(0, 400, 4), 8):
            words[k] = f"n{d}x{k}"
        rows.append((d, " ".join(words)))
    got = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter(r.component_id for r in got) == {0: 1601}


def test_forest_compares_a_pair_with_a_leader_once(spark):
    """Near copies share leads in most trees with a leader: the join makes a row a pair, not one for each such tree."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    rows = [(d, " ".join(f"n{d}x{k}" if rng.random() < 0.05 else w for k, w in enumerate(base))) for d in range(60)]
    own = lsh_forest.sets(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("root", F.col("set"))
    leaders = lsh_forest.placed(own.where("doc_id < 3").drop("doc_id"), leads=True)
    leaders = leaders.select("tree", "lead", *(F.col(c).alias(f"l_{c}") for c in ("set", "n", "root", "sketch", "leads")))
    got = [(r.x, r.y) for r in lsh_forest.met(own.drop("doc_id"), leaders).collect()]
    everywhere = lsh_forest.placed(own.drop("doc_id")).join(leaders, ["tree", "lead"]).where("root <> l_root and 100 * least(n, l_n) >= 80 * greatest(n, l_n)")
    want = {(r.set, r.l_set) for r in everywhere.select("set", "l_set").collect()}
    assert len(got) == len(set(got)) and set(got) == want and everywhere.count() > 2 * len(got)


def test_components_write_few_shuffles(spark):
    """A round's shuffles are written by as many tasks as asked for, whatever the number of partitions."""
    rng = random.Random(3)
    edges = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(300)], "a long, b long").repartition(16)
    got = simhash.components(edges, 3)
    assert got.rdd.getNumPartitions() <= 3
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, simhash.components(edges).collect()))


def test_components_take_few_rounds(spark, monkeypatch):
    """What a task's edges join is joined before the first round, and rounds end with stars; a round is a dozen of the driver's jobs."""
    rounds, real = [], simhash.common.checkpoint
    monkeypatch.setattr(simhash.common, "checkpoint", lambda df: rounds.append(1) or real(df))
    rng = random.Random(5)
    # Nodes of 16 bytes, as of lsh_forest, some with zeros at their end; chains in random order.
    name = {i: bytes(rng.randrange(256) for _ in range(14)) + bytes(2) for i in range(600)}
    chains = [(name[i], name[i + 1]) for i in range(599) if i % 50 != 49]
    rng.shuffle(chains)
    want = {name[i]: min(name[j] for j in range(i - i % 50, i - i % 50 + 50)) for i in range(600)}
    edges = spark.createDataFrame(chains, "a binary, b binary").repartition(8)
    for tasks, most in ((1, 1), (4, 20)):
        rounds.clear()
        got = {bytes(r.node): bytes(r.root) for r in simhash.components(edges, tasks).collect()}
        assert got == {x: root for x, root in want.items() if x != root} and len(rounds) <= most
    assert simhash.components(edges.limit(0), 2).count() == 0


def test_lsh_forest_joins_new_links_only(spark, monkeypatch):
    """Components are taken of each search's links between the roots so far, and not at all where a search has found none."""
    taken, real = [], lsh_forest.components
    monkeypatch.setattr(lsh_forest, "components", lambda edges, *more: taken.append(edges.count()) or real(edges, *more))
    words = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join(words[40 * (i // 2) : 40 * (i // 2) + 40] + [f"v{i}"])) for i in range(60)]
    got = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i - i % 2) for i in range(60)}
    assert taken[0] >= 25 and len(taken) <= 2 and sum(taken) == 30
