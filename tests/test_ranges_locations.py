"""Joins of ranges, ambiguous searches and locations against brute force and inverses."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from seqweave.operators import ambiguous, ranges, search
from seqweave.sources import formats, locations


def covered(a, b, n):
    return set(range(a, b + 1)) if a <= b else set(range(a, n)) | set(range(0, b + 1))


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(4)
    n = 97
    make = lambda k, key: [(i, key, rng.randrange(n), rng.choice([rng.randrange(n), 96, 0]), n) for i in range(k)]
    left, right = make(60, "x") + make(10, "y") + [(99, None, 1, 5, n), (98, "x", None, 3, n), (97, "x", 200, 3, n)], make(60, "x") + make(5, "z") + [(99, None, 1, 5, n)]
    left.append(left[0])
    schema = "id int, k string, start int, end int, length int"
    got = Counter(tuple(r) for r in ranges.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], "length").select("l_id", "r_id").collect())
    want = Counter((a[0], b[0]) for a in left for b in right if a[1] == b[1] and None not in (*a, *b) and a[2] < n and covered(a[2], a[3], n) & covered(b[2], b[3], n))
    assert got == want
    flat = [(i, rng.randrange(10**9), rng.randrange(10**6)) for i in range(80)]
    flat = [(i, "c", a, a + w * (i % 3), 0) for i, a, w in flat] + [(200, "c", 0, 2 * 10**9, 0), (201, "c", 9, 3, 0)]
    df = spark.createDataFrame(flat, "id int, k string, start long, end long, length int")
    got = Counter(tuple(r) for r in ranges.overlapping(df, df, ["k"]).select("l_id", "r_id").collect())
    assert got == Counter((a[0], b[0]) for a in flat for b in flat if a[2] <= a[3] and b[2] <= b[3] and a[2] <= b[3] and b[2] <= a[3])
    points = spark.createDataFrame([(i, "c", p) for i, p in enumerate([0, 5, 10**9, -1, None])], "p int, k string, place long")
    got = Counter((r.p, r.id) for r in ranges.held(points, df.drop("length"), ["k"], "place").collect())
    assert got == Counter((i, f[0]) for i, p in enumerate([0, 5, 10**9]) for f in flat if f[2] <= p <= f[3])


def brute_find(text, query, most, codes, circular):
    n, subject = len(text), text * 2 if circular else text
    fits = lambda q, s: (codes is None and q == s) or (codes is not None and (q not in codes or s in codes[q]))
    out = set()
    for i in range(len(subject) - len(query) + 1):
        if sum(not fits(q, s) for q, s in zip(query, subject[i : i + len(query)], strict=True)) <= most:
            out.add((i % n, (i + len(query) - 1) % n))
    return out


@pytest.mark.parametrize("ambig", [True, False])
def test_ambiguous_search_equals_brute_force(spark, ambig, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(ambiguous, "PLACES", 16)  # texts in pieces, in this process
    targets = [(f"t{i}", "".join(rng.choice("ACGTN"[: 4 + (i % 3 == 0)]) for _ in range(rng.randint(0, 60))), i % 2 == 0) for i in range(12)] + [("null", None, True)]
    probes = [(i, "".join(rng.choice("ACGTRYNU") for _ in range(rng.randint(1, 7)))) for i in range(8)] + [(90, ""), (91, None), (92, "ACGT"), (92, "ACGT")]
    codes = ambiguous.BASES if ambig else None
    for file, text, _ in targets:
        for _, q in probes:
            if text and q:
                got = [int(a) for _, at in ambiguous.found_in(text, [ambiguous.stands_for(q, codes)], 1) for a in at]
                assert len(got) == len(set(got)) and set(got) == {a for a, _ in brute_find(text, q, 1, codes, False)}
    df, qs = spark.createDataFrame(targets, "file string, sequence string, circular boolean"), spark.createDataFrame(probes, "query_id int, sequence string")
    for most in (0, 1):
        got = {tuple(r) for r in ambiguous.find_ambiguous(df, qs, most, ambig).collect()}
        comp = str.maketrans("ACGTURYN", "TGCAAYRN")
        want = set()
        for file, text, circular in targets:
            for i, q in probes:
                for strand, probe in ((1, q), (-1, q and q.translate(comp)[::-1])):
                    if text and probe and (strand == 1 or probe != q):
                        want |= {(i, file, strand, a, b) for a, b in brute_find(text, probe, most, codes, circular)}
        assert got == want


@pytest.mark.parametrize("protein", [False, True])
def test_many_short_texts_are_searched_together(spark, protein):
    rng = random.Random(17)
    bases = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    texts = [bases(240) for _ in range(12_000)]
    at = rng.sample(range(len(texts)), 90)
    own = [texts[i][60:120] for i in at]
    probes = [(i, bytes(ambiguous.translated(np.frombuffer(q.encode(), np.uint8), 0)).decode() if protein else q[:9] + "N" + q[10:]) for i, q in zip(at, own, strict=True)]
    df = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(texts)], "file int, sequence string, circular boolean").repartition(2)
    began = time.perf_counter()
    got = {tuple(r) for r in ambiguous.find_ambiguous(df, spark.createDataFrame(probes, "query_id int, sequence string"), 1, protein=protein).collect()}
    # Searched text by text this takes longer.
    assert {(i, i, 1, 60, 119) for i in at} <= got and time.perf_counter() - began < 30
    # Letters that stand for any don't join the end of a text with the next one's begin.
    free = spark.createDataFrame([(1, "NNNN" if not protein else "XX")], "query_id int, sequence string")
    two = spark.createDataFrame([(1, "ACGTA", False), (2, "", True), (3, "AC", False), (4, "ACGTAC", False)], "file int, sequence string, circular boolean")
    rows = {(r.file, r.start, r.end) for r in ambiguous.find_ambiguous(two, free, 0, protein=protein).collect()}
    assert rows == ({(4, 0, 5)} if protein else {(1, 0, 3), (1, 1, 4), (4, 0, 3), (4, 1, 4), (4, 2, 5)})


def test_mismatch_search_of_texts_full_of_seeds(spark):
    rng = random.Random(18)
    # Each place of the texts is a seed of each probe.
    texts = ["AT" * rng.randint(700, 900) for _ in range(40)] + ["at" * 90, "?T" * 40 + "\u0416T" * 9, None, ""]
    probes = [(i, "AT" * 30 + c + "AT" * i) for i in range(12) for c in "AC"] + [(90, "A\u0416T"), (91, "T\u0416T\u0416T\u0416"), (92, None), (93, "AT"), (94, "?T?T?")]
    df = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(texts)], "file int, sequence string, circular boolean").repartition(2)
    began = time.perf_counter()
    found = search.find_with_mismatches(df, spark.createDataFrame(probes, "query_id int, sequence string"), 2).collect()
    assert time.perf_counter() - began < 60
    got = {tuple(r) for r in found}
    assert len(found) == len(got) and {r[1] for r in got if r[0] == 91 and r[2] == 1} == {41}
    for f in (0, 1, 40, 41):
        text = texts[f] * 2 if f % 2 == 0 else texts[f]
        for i, q in probes:
            if i in (0, 90, 94) and q:
                want = {(a % len(texts[f]), (a + len(q) - 1) % len(texts[f])) for a in range(len(text) - len(q) + 1) if sum(x != y for x, y in zip(q, text[a : a + len(q)], strict=True)) <= 2}
                assert want <= {(s, e) for k, g, d, s, e in got if k == i and g == f and d == 1}


def test_residues_are_found_in_frames(spark):
    df = spark.createDataFrame([("a", "CCATGAAACTGGTTTAACC", False), ("b", "GGTTAAACCAGTTTCATGG", False)], "file string, sequence string, circular boolean")
    qs = spark.createDataFrame([(1, "MKLV"), (2, "MXLB"), (3, "MKL*")], "query_id int, sequence string")
    rows = {tuple(r) for r in ambiguous.find_ambiguous(df, qs, 0, protein=True).collect()}
    assert rows == {(1, "a", 1, 2, 13), (1, "b", -1, 5, 16)}
    rows = {tuple(r) for r in ambiguous.find_ambiguous(df, qs, 1, protein=True).collect()}
    assert {(2, "a", 1, 2, 13), (3, "b", -1, 5, 16)} <= rows


@pytest.mark.parametrize(
    "text, parts, strand, spans",
    [
        ("join(complement(50..60),complement(10..20))", [(49, 59, -1), (9, 19, -1)], -1, [(9, 19), (49, 59)]),
        ("complement(join(10..20,50..60))", [(49, 59, -1), (9, 19, -1)], -1, [(9, 19), (49, 59)]),
        ("join(1..5,complement(8..9))", [(0, 4, 1), (7, 8, -1)], 1, [(0, 4), (7, 8)]),
        ("J00194.1:100..202", [(99, 201, 1)], 1, []),
        ("123^124", [(122, 123, 1)], 1, [(122, 123)]),
        ("join(6501..6537,1..61)", [(6500, 6536, 1), (0, 60, 1)], 1, [(6500, 6536), (0, 60)]),
        ("complement(order(<1..5,join(7,9..>12)))", [(8, 11, -1), (6, 6, -1), (0, 4, -1)], -1, [(0, 4), (6, 6), (8, 11)]),
    ],
)
def test_locations(text, parts, strand, spans):
    found = locations.parse(text)
    assert [(p.start, p.end, p.strand) for p in found] == parts and locations.strand_of(found) == strand and locations.spans(found) == spans
    assert locations.parse(locations.write(found)) == found


def test_random_locations_are_read_as_written():
    rng = random.Random(1)
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 5)):
            a, kind = rng.randint(0, 500), rng.random()
            between = kind < 0.2
            parts.append(locations.Part(a, a + 1 if between else a + rng.randint(0, 30), rng.choice([1, -1]), rng.choice([None, "X1.2"]), between, rng.random() < 0.2, not between and rng.random() < 0.1))
        assert locations.parse(locations.write(parts)) == parts
    for bad in ("join(1..5", "1..5)", "x", "join(1..,2)", "complement"):
        with pytest.raises(ValueError):
            locations.parse(bad)


def test_flat_files_keep_parts_and_split_primers(spark):
    text = "LOCUS       p 9 bp DNA circular\nFEATURES             Location/Qualifiers\n     CDS             join(complement(5..8),complement(1..3))\n     primer_bind     complement(2..4)\n                     /label=\"fw\"\nORIGIN\n        1 acgtacgta\n//\n"
    record = formats.parse_genbank(text)[0]
    assert [f["type"] for f in record["features"]] == ["CDS"] and [(p["name"], p["strand"], p["start"]) for p in record["primers"]] == [("fw", -1, 1)]
    again = formats.parse_genbank(formats.write_genbank(record))[0]
    assert [f["parts"] for f in again["features"] + again["primers"]] == [f["parts"] for f in record["features"] + record["primers"]]
    df = spark.createDataFrame([("f", text), ("none", None), ("empty", "")], "file string, text string")
    assert [(r.type, r.part, r.start, r.strand) for r in formats.genbank_features(df).orderBy("primer", "feature", "part").collect()] == [("CDS", 0, 4, -1), ("CDS", 1, 0, -1), ("primer_bind", 0, 1, -1)]


def test_molecules_follow_the_format_and_the_options():
    protein = b">x\nMKLVAGIEFPQ\n"
    kinds = {e: formats.parse_file(f"a.{e}", protein)[0]["molecule"] for e in ("fa", "FASTA", "faa", "dna")}
    assert kinds == {"fa": "protein", "FASTA": "protein", "faa": "protein", "dna": "dna"}
    assert formats.parse_file("a.fa", protein, "dna")[0]["molecule"] == "dna" and formats.parse_file("a.dna", protein, "protein")[0]["molecule"] == "protein"
    assert [formats.parse_file("a.fa", b">x\nACGRYRYACGT\n", loose=x)[0]["molecule"] for x in (True, False)] == ["dna", "protein"]
