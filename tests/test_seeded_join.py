"""Seeded search: probes as a table against probes on the executors, and seeds by stretches against all at once."""

import random
import tracemalloc

import numpy as np
import pytest

from seqweave.operators import search


def hits(df):
    return sorted((r.file, r.probe_no, r.start, r.length, round(r.identity, 9), r.score) for r in df.collect())


def test_joined_probes_give_what_mapped_ones_give(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (3000, 700, 40, 13, 3)] + ["AC" * 300, "A" * 200, "", None]
    rows = [(f"f{i}", t) for i, t in enumerate(texts)] + [("f1", texts[1]), ("f9", "né" + texts[0][5:300].lower() + "Ω")]
    targets = spark.createDataFrame(rows, "file string, sequence string")
    probes = []
    for i in range(40):
        at = rng.randrange(0, 2900)
        probe = list(texts[0][at : at + rng.choice([12, 30, 90, 200])])
        for _ in range(len(probe) // 12):
            probe[rng.randrange(len(probe))] = rng.choice("ACGT")
        probes.append((i, rng.choice([5, 8, 11]), "".join(probe)))
    # Hanging over both ends of a text, repeats, lower case, too short for a seed, empty.
    probes += [(50, 8, "TTTTT" + texts[2][:30]), (51, 8, texts[2][-25:] + "GGGGG"), (52, 5, "AC" * 20), (53, 5, "A" * 30), (54, 8, texts[1][:40].lower()), (55, 11, "ACG"), (56, 11, ""), (57, 8, "é" + texts[0][5:40])]
    table = spark.createDataFrame(probes, "probe_no long, k int, probe string")
    mapped = hits(search.seeded_search(targets, "sequence", table, min_identity=0.7))
    monkeypatch.setattr(search, "PROBE_LETTERS", 0)
    monkeypatch.setattr(search, "FOUND", 300)
    assert hits(search.seeded_search(targets, "sequence", table, min_identity=0.7)) == mapped
    assert {50, 51, 52, 53, 54} <= {h[1] for h in mapped} and len(mapped) > 500
    none = table.where("false")
    assert search.seeded_search(targets, "sequence", none).count() == 0


@pytest.mark.parametrize("cells", [1, 7, 100])
def test_seeds_by_stretches_are_the_first_of_their_diagonals(cells, monkeypatch):
    rng = random.Random(cells)
    probes = ["".join(rng.choice("AC") for _ in range(rng.randrange(2, 14))) for _ in range(8)]
    text = "".join(rng.choice("AC") for _ in range(120))
    seeds, codes = search.Seeds(probes, 3), search._codes(text)
    monkeypatch.setattr(search, "CELLS", cells)
    monkeypatch.setattr(search, "STRETCH", 17)
    got = [tuple(map(int, x)) for part in seeds.of(codes) for x in zip(*part, strict=True)]
    want = {}
    for w, p in enumerate(probes):
        first = {}
        for q in range(len(p) - 2):
            first.setdefault(p[q : q + 3], q)
        for t in range(len(text) - 2):
            q = first.get(text[t : t + 3])
            if q is not None:
                want.setdefault((w, t - q), (w, q, t))
    assert sorted(got) == sorted(want.values())


def test_a_periodic_text_needs_bounded_memory():
    seeds, codes = search.Seeds(["A" * 60] * 200, 11), search._codes("A" * 20_000)
    tracemalloc.start()
    n = sum(len(part[0]) for part in seeds.of(codes))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200 * (20_000 - 10) and peak < 500 << 20
    assert all(isinstance(x, np.ndarray) for part in search.Seeds([], 11).of(codes) for x in part)
