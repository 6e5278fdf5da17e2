import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqweave.llm import exact_dedup, mixing, simhash

from .conftest import SCHEMA, hostile_rows


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup_matches_brute_force(hostile):
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(hostile).collect())
    rows = [(r[0], r[1] or "") for r in hostile_rows()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t), i is None, i or 0, i))
    want = Counter()
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g)[3]
        want[(i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    assert got == want


def test_exact_dedup_keeps_one_document_a_text(hostile, nothing):
    out = exact_dedup.deduplicate(hostile)
    assert out.columns == hostile.columns
    texts = [norm(r.text) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r[1]) for r in hostile_rows()})
    assert out.where("key <> 'k' OR size <> 7 OR h <> 'h'").count() == 0
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.deduplicate(nothing).count() == 0


def test_mix_meets_targets(hostile, nothing):
    rows = mixing.mix_plan(hostile).collect()
    assert len(rows) == len(hostile_rows())
    sizes = defaultdict(int)
    for r in hostile_rows():
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = sum(sizes.values())
    while open_:  # reshare until none is above its cap
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            open_.discard(s)
    taken = defaultdict(int)
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mix_plan(hostile.repartition(7)).select("doc_id", "taken").collect()
    assert Counter(map(tuple, again)) == Counter((r["doc_id"], r["taken"]) for r in rows)
    assert mixing.mix_plan(nothing).count() == 0


def test_mix_returns_documents(hostile, nothing):
    out = mixing.mix(hostile)
    assert out.columns == hostile.columns and mixing.mix(nothing).count() == 0
    assert out.where("trim(coalesce(text, '')) = ''").count() == 0
    assert out.groupBy("doc_id", "text", "source").count().agg(F.max("count")).first()[0] <= 6


def plain_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(items):
    fps = sorted({f for _, f in items})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, f in items:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return Counter((i, f"{f:016x}", least.get(find(f))) for i, f in items)


def test_simhash_matches_brute_force(hostile, nothing):
    items = [(r[0], plain_fingerprint(r[1])) for r in hostile_rows()]
    got = Counter(tuple(r) for r in simhash.near_duplicates(hostile).collect())
    assert got == brute_components(items)
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.deduplicate(nothing).count() == 0
    kept = simhash.deduplicate(hostile)
    assert kept.columns == hostile.columns
    assert {tuple(r) for r in simhash.near_duplicates(hostile, partitions=2).collect()} == set(got)


def test_simhash_tells_rows_of_one_id_by_their_texts(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(60)) for _ in range(4)]
    rows = [(1, texts[0]), (5, texts[0]), (5, texts[1]), (None, texts[2]), (None, texts[0]), (7, texts[3]), (7, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, simhash.deduplicate(docs).collect())) == Counter([(1, texts[0]), (5, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[3])])


@pytest.mark.parametrize("m", [4, 3, 2])
def test_links_lose_nothing_and_hot_values_are_probed_around(spark, m):
    rng = random.Random(m)
    hot = [rng.getrandbits(48) << 16 | 0xABCD for _ in range(300)]  # all share one 16-bit value
    near = []
    for f in hot[:60]:
        for _ in range(2):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 4)):
                g ^= 1 << b
            near.append(g)
    fps = sorted(set(hot + near + [0, 1, 3, 7, (1 << 64) - 1]))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    groups = simhash.bit_partitions(df, m)
    assert sorted(b for g in groups for b in g) == list(range(64))
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(df, groups).collect()}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3}
    assert got == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, x) for x in range(600, 640)] + [(900, 901)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[x] == 500 for x in range(600, 640)) and got[901] == 900


def test_thresholds_sum_and_cost_least():
    rng = np.random.default_rng(1)
    costs = [np.vstack([np.zeros(5), np.cumsum(rng.integers(0, 50, (4, 5)), 0)]) for _ in range(4)]
    t = simhash.allot(costs, 0)
    assert (t.sum(1) == 0).all() and (t >= -1).all()
    for q in range(5):
        best = min(
            sum(costs[i][x[i] + 1, q] for i in range(4))
            for x in np.ndindex(5, 5, 5, 5)
            for x in [tuple(v - 1 for v in x)]
            if sum(x) == 0
        )
        assert sum(costs[i][t[q, i] + 1, q] for i in range(4)) == best


def test_schema_is_the_documents(spark):
    assert [f.split()[0] for f in SCHEMA.split(", ")][:5] == ["doc_id", "text", "lang", "source", "n_chars"]
