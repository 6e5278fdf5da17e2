"""Steps whose work a row or rows a place were mended: smoothing, rows of pairs, levels of ranges."""

import math

import numpy as np
import pytest

from seqweave.operators import alignment, ranges, search, traces
from seqweave.plans import workloads


def eased(p):
    if p is None or len(p) < 2:
        return p
    out = []
    for i in range(16):
        place = i / 15 * (len(p) - 1)
        lo = math.floor(place)
        w = (1 - math.cos(math.pi * (place - lo))) / 2
        out.append(math.floor(p[lo] * (1 - w) + p[min(lo + 1, len(p) - 1)] * w + 0.5))
    return out


def test_smooth_equals_a_loop_on_odd_reads(spark):
    base = lambda *n: {c: None if k is None else [(7 * k + 13 * i) % 50 for i in range(k)] for c, k in zip("atgc", n, strict=True)}
    reads = [
        (1, [base(4, 4, 4, 4), base(6, 6, 6, 6), base(20, 3, 2, 1)]), (2, [base(9, 9, 9, 9), base(3, 3, 3, 3)]), (3, []), (4, None),
        (5, [base(0, 0, 0, 0)]), (6, [base(2, None, 0, 1)]), (7, [base(9, 1, 1, 1), base(7, 2, 2, 2), base(7, 8, 8, 8)]),
    ]
    kind = "id long, base_traces array<struct<a: array<int>, t: array<int>, g: array<int>, c: array<int>>>"
    got = {r.id: r.base_traces for r in traces.smooth(spark.createDataFrame(reads, kind).repartition(2)).collect()}
    assert list(got) and len(got) == len(reads)
    for i, bases in reads:
        n = sorted(len(b["a"]) for b in bases or [])
        few = n and 0 < n[len(n) // 2] < traces.SMOOTH_BELOW
        want = None if bases is None else [{c: eased(b[c]) if few else b[c] for c in "atgc"} for b in bases]
        assert (None if got[i] is None else [x.asDict() for x in got[i]]) == want


@pytest.mark.parametrize("rows", [("A--C-", "A-GC-"), ("", ""), ("é-漢-", "é--A"), ("--", "--"), ("AC", "A-GT-"), (None, "A")])
def test_pair_rows_lose_only_common_gaps(rows):
    want = {("A--C-", "A-GC-"): ("A-C", "AGC"), ("", ""): ("", ""), ("é-漢-", "é--A"): ("é漢-", "é-A"), ("--", "--"): ("", ""), ("AC", "A-GT-"): ("AC", "A-GT"), (None, "A"): (None, None)}
    assert alignment.pair_rows(*rows) == want[rows]


def test_ranges_take_as_many_levels_as_there_are_places(spark):
    rows = [("k", i, (i * 37) % 50, (i * 37 + i % 45) % 50, 50) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, id long, start long, end long, length long")
    pairs = [sorted((r.l_id, r.r_id) for r in ranges.overlapping(df, df, ["k"], "length", **n).select("l_id", "r_id").collect()) for n in ({}, {"levels": (50).bit_length()})]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 60
    point = ranges.held(df.select("k", "id", "start").limit(1), df.select("k", "length", df.start.alias("s"), "end"), ["k"], "start", "s", "end", "length", 6)
    assert "sequence(0, 6" in point._jdf.queryExecution().analyzed().toString()


def test_bases_are_cut_by_runs(spark):
    text = "Ab-c\n  gT漢字xyA"
    assert spark.range(1).selectExpr("'Ab-c\\n  gT漢字xyA' AS t").selectExpr(workloads.BASES.format("t")).first()[0] == "".join(x for x in text.upper() if x in "ACGT")
    assert "]+" in workloads.BASES


def test_seeds_of_texts_one_behind_the_other():
    """Short texts are looked up together: the same seeds and matches as text by text, none across two, and all diagonals of each."""
    rng = np.random.default_rng(7)
    word = lambda n: "".join(rng.choice(list("AB"), n))
    texts = ["", *(word(n) for n in (1, 2, 3, 40, 7, 90, 0, 5, 300)), "ABBA" * 9, "BBA"]
    index = search.Seeds([word(n) for n in (3, 5, 9, 17, 17)], 3)
    hits = lambda text, ends, firsts: [
        (r, w, s - b, n, m, x)
        for which, q, t in index.of(text, ends)
        for row in [np.searchsorted(ends, t, "right")]
        for r, w, b, s, n, m, x in zip(row.tolist(), which.tolist(), firsts[row].tolist(), *(c.tolist() for c in search.extend(text, index, which, q, t, 2, firsts[row], ends[row] - 1)), strict=True)
    ]
    want = [(i, *h[1:]) for i, s in enumerate(texts) for h in hits(search._codes(s), np.array([len(s) + 1]), np.array([0]))]
    sizes = np.array([len(s) + 1 for s in texts])
    got = hits(search._codes("\0".join(texts)), np.cumsum(sizes), np.cumsum(sizes) - sizes)
    assert len(got) > 500 and sorted(got) == sorted(want)
    alone = search.extend(search._codes(texts[6]), index, *next(index.of(search._codes(texts[6]))), 2)
    assert sorted(zip(*(c.tolist() for c in alone), strict=True)) == sorted(h[2:] for h in want if h[0] == 6)
