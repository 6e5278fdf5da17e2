"""Worked examples, inverses and brute force for the engine's own operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqweave.functions import annotations, codons
from seqweave.functions import sequences as S
from seqweave.functions.register import register
from seqweave.operators import align_options, aligner, alignment, hits, inventory, primers, scans, search, tables, traces
from seqweave.sources import exports
from seqweave.sources import formats as M
from seqweave.streaming import index


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_reverse_complement_twice_and_unknown_letters(spark):
    assert one(spark, S.rev_comp(S.rev_comp(F.lit("acgtRYSWKMBDHVN")))) == "ACGTRYSWKMBDHVN"
    assert one(spark, S.rev_comp(F.lit("AUX"))) == "NAT"


@pytest.mark.parametrize("s,kind", [("", "dna"), ("A" * 91 + "E" * 9, "dna"), ("A" * 90 + "E" * 10, "protein"), ("MKLVAGIE", "protein")])
def test_molecule_is_dna_over_nine_tenths(spark, s, kind):
    assert one(spark, S.guess_molecule(F.lit(s))) == kind


def test_melting_point(spark):
    assert one(spark, S.round_half_up(S.melting_point(F.lit("AT")))) == -210.3
    assert one(spark, S.melting_point(F.lit("A"))) is None and one(spark, S.melting_point(F.lit("ACNT"))) is None


@pytest.mark.parametrize("m,c,want", [(None, 100, None), (1, 4489, "mismatch"), (0, 4489, "match"), (0, 900, "partial match"), (0, 49, "mismatch"), (0, 50, "partial match")])
def test_verdicts(spark, m, c, want):
    assert one(spark, S.verdict(F.lit(m).cast("int"), F.lit(c), F.lit(4489))) == want


def test_small_scalars(spark):
    assert one(spark, S.column_number(F.lit("BC12"))) == 54
    assert one(spark, S.identity_label(F.lit(1000), F.lit(1), F.lit(0))) == "99.9% identical"
    assert one(spark, S.translate_codon(F.lit("aug"))) == "M" and one(spark, S.translate_codon(F.lit("ANG"))) == ""
    assert one(spark, S.leading_number(F.lit("61.5 C"))) == 61.5 and one(spark, S.leading_number(F.lit("warm"))) is None
    assert one(spark, S.derive_bases(F.lit("AACCGGTT"), F.lit(6), F.lit(1), F.lit(1), F.lit(True))) == "TTAA"
    assert one(spark, S.derive_bases(F.lit("AACCGGTT"), F.lit(6), F.lit(1), F.lit(-1), F.lit(True))) == "TTAA"
    names = spark.createDataFrame([("r10",), ("R2",), ("r1",)], "n string").orderBy(S.natural_key("n"))
    assert [r.n for r in names.collect()] == ["r1", "R2", "r10"]


def test_codon_edit_stands_out(spark):
    assert one(spark, codons.apply_codon(F.lit("AAACCCGGG"), F.lit(3), F.lit(True), F.lit("uuu"))) == "AAAtttGGG"
    assert one(spark, codons.apply_codon(F.lit("aaacccggg"), F.lit(3), F.lit(False), F.lit("TTA"))) == "aaaTAAggg"
    assert one(spark, codons.apply_codon(F.lit("ACGTACGT"), F.lit(7), F.lit(True), F.lit("GGG"))).upper() == "GGGTACGG"
    table = spark.createDataFrame([("o", "TTT 0.59 26.1  UUC 0.41 18.4")], "organism string, text string")
    rows = [tuple(r) for r in codons.parse_usage(table).orderBy("codon").collect()]
    assert rows == [("o", "TTC", "F", 0.41, 18.4), ("o", "TTT", "F", 0.59, 26.1)]


def test_locations_across_the_origin(spark):
    two = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 4), (90, 99))])
    assert one(spark, annotations.restates_origin(two, F.lit(90), F.lit(4), F.lit(100)))
    assert not one(spark, annotations.restates_origin(two, F.lit(90), F.lit(5), F.lit(100)))


def plain_fuzzy(t, q, k=11, ident=0.8, cover=0.5, drop=8):
    first = {}
    for i in range(len(q) - k + 1):
        first.setdefault(q[i : i + k], i)
    seen, out = set(), set()
    for at in range(len(t) - k + 1):
        p = first.get(t[at : at + k])
        if p is None or at - p in seen:
            continue
        seen.add(at - p)
        ends, total = [], k
        for step in (-1, 1):
            i, j = (at - 1, p - 1) if step < 0 else (at + k, p + k)
            score = top = reach = n = 0
            while 0 <= i < len(t) and 0 <= j < len(q):
                n += 1
                score += 1 if t[i] == q[j] else -1
                if score > top:
                    top, reach = score, n
                if top - score > drop:
                    break
                i, j = i + step, j + step
            ends.append(reach)
            total += top
        length = sum(ends) + k
        if (length + total) / 2 / length >= ident and length >= len(q) * cover:
            out.add((at - ends[0], length, total))
    return out


def test_seeded_search_equals_a_plain_one(spark):
    rng = random.Random(7)
    query = bases(rng, 60)
    targets = []
    for i in range(30):
        hit = "".join(rng.choice("ACGT") if rng.random() < 0.08 else c for c in query)
        targets.append((i, bases(rng, 100) + hit[rng.randint(0, 20) :] + bases(rng, rng.randint(0, 60))))
    df = spark.createDataFrame(targets, "i int, t string")
    probes = spark.createDataFrame([(1, query), (2, "ACG")], "probe_no long, probe string")
    got = {(r.i, r.start, r.length, r.score) for r in search.seeded_search(df, "t", probes).collect()}
    assert got == {(i, *h) for i, t in targets for h in plain_fuzzy(t, query)} and len(got) >= 20
    assert search.seeded_search(df, "t", probes.limit(0)).count() == 0


def test_exact_search_both_strands_and_palindromes(spark):
    corpus = spark.createDataFrame([("f", "n", "AAAATTGAATTCGG")], "file string, name string, sequence string")
    queries = spark.createDataFrame([(1, "AA"), (2, "GAATTC"), (3, "")], "query_id int, sequence string")
    got = sorted((r.query_id, r.strand, r.start, r.end) for r in search.exact_search(corpus, queries).collect())
    assert got == sorted([(1, 1, 0, 1), (1, 1, 1, 2), (1, 1, 2, 3), (1, 1, 7, 8), (1, -1, 4, 5), (1, -1, 9, 10), (2, 1, 6, 11)])
    assert search.exact_search(corpus, queries.limit(0)).count() == 0


def test_protein_search_maps_to_bases(spark):
    orf = "ATGAAACTGGTTGCTGGTATTGAA"  # MKLVAGIE
    corpus = spark.createDataFrame([("f", "n", "C" + orf), ("r", "n", S_rc("C" + orf))], "file string, name string, sequence string")
    peptides = spark.createDataFrame([(1, "MKLVAGIE")], "query_id int, sequence string")
    got = {(r.file, r.frame, r.start, r.end, r.length) for r in search.protein_exact_search(corpus, peptides).collect()}
    assert got == {("f", 2, 1, 24, 8), ("r", -2, 0, 23, 8)}
    fuzzy = {(r.file, r.frame, r.start, r.end) for r in search.protein_fuzzy_search(corpus, peptides).collect()}
    assert fuzzy >= {("f", 2, 1, 24), ("r", -2, 0, 23)}


def S_rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_mismatch_search_equals_brute_force_around_the_origin(spark):
    rng = random.Random(11)
    seq = bases(rng, 200)
    query = (seq[190:] + seq[:14])[:24]
    query = query[:5] + ("A" if query[5] != "A" else "C") + query[6:]
    got = {(r.strand, r.start, r.end) for r in search.find_with_mismatches(spark.createDataFrame([("f", seq, True)], "file string, sequence string, circular boolean"), spark.createDataFrame([(1, query)], "query_id int, sequence string"), 3).collect()}
    want = set()
    for strand, p in ((1, query), (-1, S_rc(query))):
        for i in range(len(seq) * 2 - len(p) + 1):
            if sum(a != b for a, b in zip((seq + seq)[i : i + len(p)], p, strict=True)) <= 3:
                want.add((strand, i % 200, (i + len(p) - 1) % 200))
    assert got == want and (1, 190, 13) in got


def test_primer_across_the_origin_keeps_its_longest_anneal(spark):
    rng = random.Random(5)
    seq = bases(rng, 300)
    primer = seq[-10:] + seq[:20]
    templates = spark.createDataFrame([("c", seq, True), ("l", seq, False)], "file string, sequence string, circular boolean")
    inv = spark.createDataFrame([(1, "across", primer), (2, "tail", "gggg" + seq[50:70]), (3, "back", S_rc(seq[100:125])), (4, "short", "ACGT"), (5, "odd", "ACGTNNACGTACGTACG")], "ord int, name string, sequence string")
    hits = {(r.file, r.name): r for r in primers.primer_search(templates, inv).collect()}
    a = hits["c", "across"]
    assert (a.anneal, a.overhang, a.start, a.end, a.wraps) == (30, 0, 290, 19, True) and hits["l", "across"].anneal == 20
    assert (hits["c", "tail"].overhang, hits["c", "tail"].start, hits["c", "tail"].three_prime) == (4, 50, 69)
    assert (hits["c", "back"].strand, hits["c", "back"].three_prime) == (-1, 100) and ("c", "short") not in hits
    products = primers.in_silico_pcr(primers.primer_search(templates, inv), 200).collect()
    assert {(r.file, r.forward, r.reverse, r.length) for r in products} >= {("l", "tail", "back", 75)}


def test_products_of_primers_across_the_origin(spark):
    rows = [("t", "f1", 1, 5990, 10), ("t", "f2", 1, 100, 130), ("t", "r1", -1, 150, 180), ("t", "r2", -1, 5980, 20), ("t", "r3", -1, 5000, 5020)]
    hits = spark.createDataFrame(rows, "file string, name string, strand int, start long, `end` long")
    f, r = ([x for x in rows if x[2] == s] for s in (1, -1))
    want = {(a[1], b[1], b[4] - a[3] + 1) for a in f for b in r if a[4] < b[3] and b[4] - a[3] < 3000}
    got = [(x.forward, x.reverse, x.length) for x in primers.in_silico_pcr(hits, 3000).collect()]
    assert len(got) == len(want) == 5 and set(got) == want


def pair(spark, ref, read, wraps):
    return spark.createDataFrame([(ref, read, wraps)], "reference_row string, read_row string, wraps boolean")


def test_difference_counting(spark):
    rows = ("AAAACCCCGGGGTTTT", "AAAA--------TTTT")
    for wraps, gaps in ((True, 0), (False, 8)):
        r = alignment.count_differences(pair(spark, *rows, wraps)).first()
        assert (r.substitutions, r.gaps, r.compared, r.identity) == (0, gaps, 8, 1.0)
    r = alignment.count_differences(pair(spark, "ACGT", "----", False)).first()
    assert (r.compared, r.gaps, r.identity) == (0, 0, 0.0)


def test_folding(spark):
    df = spark.createDataFrame([("ACGTACGTAC" * 2, "------CGTA--GT------"[:20].replace("C", "G", 1), 10)], "doubled_row string, read_row string, reference_length long")
    r = alignment.fold_reads(df).first()
    assert [tuple(x) for x in r.covered] == [(2, 3), (6, 9)] and [tuple(x) for x in r.deleted] == [(0, 1)] and len(r.read_index) == 6


def test_codecs_invert(spark):
    assert one(spark, alignment.encode_runs(F.array(*map(F.lit, [3, 4, 5, 9, 1, 2])))) == "3:3,9:1,1:2"
    assert one(spark, alignment.decode_runs(F.lit("3:3, 9:1,x,1:2"))) == [3, 4, 5, 9, 1, 2]
    assert one(spark, alignment.encode_ranges(alignment.decode_ranges(F.lit("12-40,90, x")))) == "12-40,90"


def test_islands_and_ranges(spark):
    df = spark.createDataFrame([("a", i) for i in (1, 2, 3, 7, 8, 10)], "k string, at int")
    assert sorted((r.run_from, r.run_to) for r in tables.islands(df, ["k"], "at").collect()) == [(1, 3), (7, 8), (10, 10)]


def test_searches_take_every_benchmark_row_whole(spark, tmp_path):
    from seqweave.plans import catalog

    rng = random.Random(5)
    texts = [bases(rng, n) for n in (60, 150, 240)]
    items = [texts[2][30:39], texts[1][20:32], texts[0][3:20], texts[2][60:108], "ACG", ""]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = {k: catalog.queries()[k](spark, str(tmp_path)).collect() for k in ("find_with_mismatches", "protein_exact_search", "protein_fuzzy_search")}
    want = set()
    for q, item in enumerate(items):
        for strand, p in {(1, item)} | ({(-1, S_rc(item))} if S_rc(item) != item else set()):
            for d, text in enumerate(texts):
                ring = text * 2 if d % 2 == 0 else text
                for i in range(len(ring) - len(p) + 1 if len(p) > 2 else 0):
                    if sum(a != b for a, b in zip(ring[i : i + len(p)], p, strict=True)) <= 2:
                        want.add((q, f"doc{d}", strand, i % len(text), (i + len(p) - 1) % len(text)))
    assert {tuple(r) for r in run["find_with_mismatches"]} == want and {0, 1, 2, 3} <= {r[0] for r in want}
    whole = {(0, "doc2", 30, 38, 3), (1, "doc1", 20, 31, 4), (2, "doc0", 3, 17, 5), (3, "doc2", 60, 107, 16)}
    assert whole <= {(r.query_id, r.file, r.start, r.end, r.length) for r in run["protein_exact_search"]}
    assert whole <= {(r.query_id, r.file, r.start, r.end, r.length) for r in run["protein_fuzzy_search"]}


def test_aligner_finds_planted_changes():
    rng = random.Random(3)
    for _ in range(20):
        ref = bases(rng, 600)
        at = rng.randint(50, 150)
        read = list(ref[at : at + 400])
        subs = {100, 200, 300}
        for p in subs:
            read[p] = next(c for c in "ACGT" if c != read[p])
        text = "".join(read[:150] + read[160:])  # ten bases deleted
        flip = rng.random() < 0.5
        out = aligner.align_read(ref, S_rc(text) if flip else text, False)
        strand, anchored, _, top, low, *_, s, g, c, _, _ = out
        assert strand == (-1 if flip else 1) and anchored and (s, g, c) == (3, 10, 390)
        assert top.replace("-", "") == ref and low.replace("-", "") == text and len(top) == len(low)


def affine_score(top, low):
    """Score of an alignment, gaps at its ends free."""
    a, b = (max(len(x) - len(x.lstrip("-")) for x in (top, low)), min(len(x.rstrip("-")) for x in (top, low)))
    total = gap = 0
    for r, q in zip(top[a:b], low[a:b], strict=True):
        now = 1 if r == "-" else 2 if q == "-" else 0
        total += (aligner.MATCH if r == q else aligner.MISMATCH) if not now else -aligner.EXTEND if now == gap else -aligner.OPEN
        gap = now
    return total


def full_table(ref, read):
    """The best score with free ends, cell by cell."""
    low, n = -(10**9), len(ref)
    h, v, best = [0] * (n + 1), [low] * (n + 1), 0
    for q in read:
        above, side, row = h, low, [0]
        for j in range(1, n + 1):
            v[j] = max(above[j] - aligner.OPEN, v[j] - aligner.EXTEND)
            side = max(row[-1] - aligner.OPEN, side - aligner.EXTEND)
            row.append(max(above[j - 1] + (aligner.MATCH if ref[j - 1] == q else aligner.MISMATCH), v[j], side))
        h, best = row, max(best, row[-1])
    return max(best, *h)


def test_aligner_equals_a_full_table():
    rng = random.Random(21)
    ref = bases(rng, 700)
    reads = [ref[:200] + ref[500:], ref[:250] + bases(rng, 200) + ref[250:500], bases(rng, 90), ref[300:360] + bases(rng, 30) + ref[40:90]]
    for read in reads:
        for offset in (None, 0, 300, 600):
            top, low = aligner.align_pair(ref, read, offset)
            assert (top.replace("-", ""), low.replace("-", "")) == (ref, read) and affine_score(top, low) == full_table(ref, read)


def test_aligner_takes_long_reads_without_an_anchor():
    rng = random.Random(22)
    ref = bases(rng, 2500)
    read = "".join(rng.choice("ACGT") if k % 9 == 8 else x for k, x in enumerate(ref[200:2200]))
    top, low = aligner.align_pair(ref, read)
    assert sum(a == b for a, b in zip(top, low, strict=True)) > 1700
    top, low = aligner.align_pair(ref, ref[:900] + ref[1500:], 0)  # 600 bases deleted
    assert aligner.differences(top, low) == (0, 600, 1900)


def test_aligner_folds_a_read_across_the_origin():
    rng = random.Random(8)
    ref = bases(rng, 700)
    read = (ref + ref)[500:1000]
    out = aligner.align_read(ref, read, True)
    assert (out[8], out[9], out[10]) == (0, 0, 500)
    gone = (ref + ref)[500:690] + (ref + ref)[730:1000]  # forty bases at the origin are missing
    strand, _, _, _, low, covered, deleted, crosses, s, g, c, *_ = aligner.align_read(ref, gone, True)
    assert (strand, crosses, s, g, c) == (1, True, 0, 40, 460) and deleted == [{"from": 690, "to": 29}]
    assert aligner.align_read("", "ACGT", True)[3] is None and aligner.align_read(None, None, True)[3] is None


def test_row_walks_equal_their_definitions():
    """The array forms of folding, moving and tallying against a walk over the columns."""
    rng = random.Random(31)
    for _ in range(60):
        n = rng.randint(1, 40)
        doubled = "".join(rng.choice("ACGT--"[:4] if rng.random() < 0.9 else "-") for _ in range(2 * n))
        read = "".join(rng.choice("ACGT---") for _ in doubled)
        size = max(1, (len(doubled.replace("-", "")) + 1) // 2)
        at = reads = -1
        placed, extra = {}, 0
        for r, q in zip(doubled, read, strict=True):
            at, reads = at + (r != "-"), reads + (q != "-")
            if r == "-":
                extra += q != "-" and at >= 0
            elif q != "-":
                placed[at % size] = (q, reads)
        covered, _, insertions, sequence, order = alignment.fold_one(doubled, read, size)
        held = sorted(placed)
        assert insertions == extra and sequence == "".join(placed[p][0] for p in held) and order == [placed[p][1] for p in held]
        assert [p for c in covered for p in range(c["from"], c["to"] + 1)] == held
        spans = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 3))]
        inside = [any((a <= p <= b) if a <= b else (p >= a or p <= b) for a, b in spans) for p in range(n)]
        assert alignment.within(n, spans).tolist() == inside
        notes = [{"name": "x", "start": a, "end": b, "strand": 1, "locations": None} for a, b in spans[:1]]
        index = rng.sample(range(n), rng.randint(1, n))
        moved = traces._move(notes, -1, index, n)[0]
        want = {c for c, p in enumerate(index) if notes and alignment.within(n, spans[:1])[n - 1 - p]}
        assert {c for m in moved for c in range(m["start"], m["end"] + 1)} == want and all(m["strand"] == -1 for m in moved)


def test_multiple_alignment_shares_slots():
    rows = aligner.star("ACDEF", [("AC-DEF", "ACXDEF"), ("ACDEF", "--DEF"), ("AC-DEF", "ACYDEF")])
    assert rows == ["AC-DEF", "ACXDEF", "---DEF", "ACYDEF"]
    top, low = aligner.tidy_ends("ACGTACGTAC" + "G" * 40 + "TTA", "ACGTACGTAC" + "-" * 40 + "--A")
    assert low.replace("-", "") == "ACGTACGTACA" and len(top) == len(low)


def test_quality_trim_keeps_all_if_nothing_is_left(spark):
    def span(q, least):
        r = one(spark, traces.quality_span(F.array(*map(F.lit, q)), least))
        return r.start, r.end

    assert span([12] * 3 + [47] * 20 + [12] * 3, 20) == (3, 22)
    assert span([5] * 8, 20)[0] >= span([5] * 8, 20)[1] - 0
    df = spark.createDataFrame([("ACGTACGT", [5] * 8)], "sequence string, quality array<int>")
    assert traces.trim_by_quality(df, 20).first().sequence == "ACGTACGT"


def test_cart_and_inventory(spark):
    events = spark.createDataFrame([("s", 1, "a", "ac gt", "/1"), ("s", 2, "b", "ACGT", "/2"), ("s", 3, "c", "ACGT", "/1"), ("s", 4, "d", "GGG", "/1"), ("s", 5, "e", "TTT", ""), ("s", 6, "f", "ACGT", "/2"), ("s", 7, "g", " ", "/2")], "session string, ord int, name string, sequence string, source_path string")
    rows = {r.key: r for r in inventory.cart_items(events, 2).collect()}
    assert set(rows) == {"ACGT", "GGG"} and rows["ACGT"].also_found_in == ["/2"] and rows["ACGT"].name == "a"
    c = inventory.cart_counts(events, 2).first()
    assert (c.added, c.duplicates, c.refused) == (2, 3, 1)
    items = spark.createDataFrame([("x", "acgt")], "name string, sequence string")
    inv = spark.createDataFrame([(1, "one", "AC GT"), (2, "two", "ACGT"), (3, "none", " ")], "row_no int, name string, sequence string")
    assert inventory.annotate(items, inv).first().match_name == "one"
    r = inventory.annotate(items, None, "error").first()
    assert (r.match_status, r.found) == ("unknown", False)
    assert tuple(inventory.load_result(inv).first()) == (2, 1, 1)


def test_delimited():
    assert M.parse_delimited('a,"b, ""c""\nd"\r\n\r\n,x') == [["a", 'b, "c"\nd'], [""], ["", "x"]]
    assert M.parse_delimited("a\tb,c\td\n1\t2\t3\n") == [["a", "b,c", "d"], ["1", "2", "3"]]


def test_pasted_layouts(spark):
    wrapped = "\n".join(["ACGTACGTAC" * 5] * 3 + ["ACGT"])
    cases = [
        ("name,seq\np1,ACGTACGT\n", [("p1", "ACGTACGT")]),
        (" 1 acgtacgtac\n11 acgtacgtac", [("", "1 acgtacgtac 11 acgtacgtac")]),
        (">x\nAC\nGT\n>y", [("x", "ACGT"), ("y", "")]),
        (None, []), ("", []), (" \n\t\n", []),
        ("1\tACGTACGT\t\r\n2\tGGGTACGT\trev", [("", "ACGTACGT"), ("rev", "GGGTACGT")]),
        ('"a, b",ACGTAC\nc,GGTACA', [("a, b", "ACGTAC"), ("c", "GGTACA")]),
        ("T7 TAATACGACT\nSP6 ATTTAGGTGA", [("T7", "TAATACGACT"), ("SP6", "ATTTAGGTGA")]),
        (wrapped, [("", wrapped.replace("\n", " "))]),
        ("ACGT\nGGG", [("", "ACGT"), ("", "GGG")]),
        ("5\tACGTACGT\n7\tACGTACGA", [("5", "ACGTACGT"), ("7", "ACGTACGA")]),
    ]
    df = spark.createDataFrame(list(enumerate(c for c, _ in cases)), "i int, text string")
    got = {r.i: [tuple(x) for x in r.e] for r in df.select("i", M.pasted_rows("text").alias("e")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    assert M.pasted_table(df).count() == sum(len(w) for _, w in cases)


def test_safe_ids_chain():
    assert M.safe_ids(["a b", "a_b", "a_b_2", "", "é"]) == ["a_b", "a_b_2", "a_b_2_2", "seq4", "_"]


def test_genbank_round_trip():
    record = {"name": "p", "sequence": bases(random.Random(1), 130), "circular": True, "features": [{"name": "x", "type": "CDS", "start": 120, "end": 9, "strand": -1, "locations": []}]}
    (back,) = M.parse_genbank(M.write_genbank(record))
    assert (back["sequence"], back["circular"]) == (record["sequence"], True)
    f = back["features"][0]
    assert (f["start"], f["end"], f["strand"], f["name"], len(f["locations"])) == (120, 9, -1, "x", 2)


def test_sheets_and_traces():
    rows = [["Name", "", "Seq"], ["a & b", "<x>", ""], [], ["", "", "z"]]
    assert M.read_sheet(M.write_sheet(rows, "Main")) == [["Name", "", "Seq"], ["a & b", "<x>"], [], ["", "", "z"]]
    with pytest.raises(ValueError, match="not found"):
        M.read_sheet(M.write_sheet(rows), "other")
    for n in (2, 12):
        data = M.write_abif("ACGT"[:n] if n < 4 else "ACGTACGTACGT", [3 + 6 * i for i in range(n)], {c: list(range(80)) for c in "atgc"}, [1] * n)
        a = M.parse_abif(data)
        assert len(a["sequence"]) == n and a["quality"] is None and a["peaks"][0] == 3
    with pytest.raises(ValueError):
        M.parse_abif(b"none")


def test_saved_alignment_widths():
    text = M.write_stockholm({"name": "r", "row": "AC-GT"}, [{"name": "q", "row": "ACCG-", "strand": -1, "covered": "0-3"}])
    rows = M.read_stockholm(text)
    assert [r["row"] for r in rows] == ["AC-GT", "ACCG-"] and rows[1]["strand"] == -1 and rows[1]["covered"] == "0-3"
    assert (rows[1]["trim"], rows[1]["bases"], rows[0]["circular"]) == (0, None, False)
    assert M.stockholm_meta(text)["alphabet"] == "dna" and M.stockholm_meta("# STOCKHOLM 1.0\nr  MKVLE-FQ\n//\n")["alphabet"] == "protein"
    with pytest.raises(ValueError, match="columns"):
        M.read_stockholm("# STOCKHOLM 1.0\nr  ACGT\nq  AC\n//\n")


def test_files_tracks_and_stream(spark, tmp_path):
    folder = tmp_path / "maps"
    (folder / "sub" / ".hidden").mkdir(parents=True)
    one_file = M.write_genbank({"name": "a", "sequence": "ACGTACGT", "features": []})
    (folder / "a.gb").write_text(one_file)
    (folder / "sub" / "b.gbk").write_text(one_file + one_file)
    (folder / "sub" / ".hidden" / "c.gb").write_text(one_file)
    files = M.read_files(spark, str(folder))
    assert files.count() == 2 and M.left_out(spark, str(folder)) == 0
    assert M.read_files(spark, str(folder), most=1).count() == 1 == M.left_out(spark, str(folder), most=1)
    assert sorted(r.name for r in M.tracks(files).collect()) == ["a", "b · a", "b · a"]
    bad = spark.createDataFrame([("x.ab1", bytearray(b"junk"))], "path string, content binary")
    assert M.tracks(bad).first().molecule is None
    index.watch(spark, str(folder), str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination()
    (folder / "d.gb").write_text(one_file)
    index.watch(spark, str(folder), str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination()
    rows = index.current(spark, str(tmp_path / "index")).collect()
    assert len(rows) >= 3 and {r.sequence for r in rows} == {"ACGTACGT"}


def test_export_lines_are_one_ordered_file(spark, tmp_path):
    items = spark.createDataFrame([(2, "b,c", "GT"), (1, 'a"', "AC")], "ord int, name string, sequence string")
    exports.write_lines(exports.tsv_lines(items), str(tmp_path / "out"), ["ord"], "Name\tSequence")
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == 'Name\tSequence\na"\tAC\nb,c\tGT\n'
    assert exports.csv_header().startswith("﻿Name,Sequence,Length,Tm (°C)")


def test_scans(spark):
    orf = "ATG" + "GCT" * 25 + "TAA"
    c = spark.createDataFrame([("f", "CC" + orf, False)], "file string, sequence string, circular boolean")
    assert [(r.frame, r.start, r.end, r.residues) for r in scans.orf_scan(c).collect()] == [(3, 2, 82, 26)]
    sites = spark.createDataFrame([("c", "TTCAAAAGAA", True)], "file string, sequence string, circular boolean")
    assert {(r.enzyme, r.start) for r in scans.cut_sites(sites).collect()} == {("EcoRI", 7)}


def test_sql_functions(spark):
    register(spark)
    assert spark.sql("SELECT rev_comp('AAC') AS x, in_window(1, 9, 2) AS w").first().x == "GTT"
    assert [r.kmer for r in spark.sql("SELECT k.kmer FROM VALUES ('ACGT') t(s), LATERAL kmers(s, 3) k").collect()] == ["ACG", "CGT"]


def test_checked_broadcast(spark):
    small, large = spark.range(5), spark.range(50)
    assert "broadcast" in tables.small(small, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in tables.small(large, 10)._jdf.queryExecution().logical().toString().lower()


def test_numpy_is_exact_for_kmers():
    assert len(np.unique(search._rolled(search._codes("ACGTACGT"), 4))) == 4



def test_align_options_round_trip():
    o = align_options.parse("--localpair --maxiterate 1000 --op 2.5 --ep=0.1")
    assert (o.strategy, o.gap_open, o.gap_extend) == ("accurate", 2.5, 0.1) and align_options.parse(align_options.compose(o)) == o
    assert align_options.parse("") == align_options.parse(None) == align_options.Options()
    custom = align_options.parse("--retree 3 --op x")
    assert (custom.strategy, custom.custom, custom.gap_open) == ("custom", "--retree 3 --op x", None)
    faults = [align_options.Options("none"), align_options.Options("custom"), align_options.Options("custom", "file.fa"), align_options.Options("custom", "- --x"), align_options.Options(gap_open=-1.0)]
    assert all(align_options.fault(f) for f in faults) and align_options.fault(o) is None
    assert align_options.fault(o, 61) and align_options.fault(o, 20) is None


def test_hit_tables(spark):
    assert hits.visible(["Note", "Other"], alias="Other") == ["pos", "str", "name", "tm", "anneal", "tail", "Other"]
    assert hits.visible(["Note"], chosen=[]) == ["pos", "str", "name"]
    schema = "name string, sequence string, strand int, three_prime long, wraps boolean, anneal long, overhang long, tm double, extra map<string,string>"
    df = spark.createDataFrame([(None, "ACGT", -1, 4, True, 15, 2, None, {"Note": "Blue"}), ("x", "GG", 1, 0, False, 16, 0, 51.5, None)], schema)
    rows = hits.table(df, hits.visible(["Note"], chosen=["tm", "tail", "Note"])).collect()
    assert tuple(rows[0]) == ("5↩", "−", "(unnamed)", "—", "+2", "Blue") and tuple(rows[1]) == ("1", "+", "x", "51.5", "—", "")
    count = lambda text, columns: hits.text_filter(df, text, columns).count()
    assert (count("blue", ["Note"]), count("blue", []), count("cgt", []), count(" ", [])) == (1, 0, 1, 2)


def test_ingest_numbers_past_names_that_are_taken(spark):
    rows = [(1, "", "acgt"), (2, "sequence2", "GG1 23"), (3, None, "TT"), (4, "", " "), (5, "", "AC*GT"), (6, "", "MKVL"), (7, "x", None), (8, "", "CC*")]
    got = {r.row_no: (r.label, r.bases, r.reason) for r in inventory.ingest(spark.createDataFrame(rows, "row_no int, name string, sequence string"), F.lit("dna")).collect()}
    assert got == {1: ("sequence1", "ACGT", None), 2: ("sequence2", "GG", None), 3: ("sequence3", "TT", None), 5: ("", "AC*GT", "stop inside"), 6: ("", "MKVL", "not dna"), 7: ("x", "", "empty"), 8: ("sequence4", "CC", None)}


def test_protein_alignment(spark):
    top, low, s, g, c, m, identity = aligner.align_protein("MKTAYIAKQRQISFVKSHFSRQ", "MKTAYIAQRQISFVKSHWSRQ")
    assert (s, g, c, m) == (1, 1, 21, 2) and top.replace("-", "") == "MKTAYIAKQRQISFVKSHFSRQ" and identity == 20 / 21
    assert aligner.align_protein("", "MK") == (None,) * 7
    df = spark.createDataFrame([(1, "a", "MKTAYIAKQR", "MKTAYIAKQR"), (1, "b", "MKTAYIAKQR", "MKTAYWIAKQR"), (2, "c", "MK", "")], "g int, name string, reference string, read string")
    rows = aligner.joint(aligner.align_proteins(df).select("g", "name", "reference_row", "read_row"), ["g"]).collect()
    assert [(x.name, x.row) for x in rows[0].rows] == [("", "MKTAY-IAKQR"), ("a", "MKTAY-IAKQR"), ("b", "MKTAYWIAKQR")] and len(rows) == 1


def test_rebuild_takes_what_fits_the_row(spark):
    read = "AACCGGTTAC"
    turned = alignment.column_order(read, -1, 3, None)
    back = read.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert turned == back[3:] + back[:3] and alignment.column_order(read, 1, 0, [2, 3, 20]) == "CC-" and alignment.column_order("MK", -1, 0, None, "protein") == "MK"
    row = turned[:4] + "--" + turned[4:]
    rows = [(row, -1, 3, None, read.lower(), None), (row, -1, 3, None, "ACGT", read), (row, -1, 3, None, None, "TT"), ("GG-TA", 1, 0, [6, 7, 1, 2], None, None)]
    df = spark.createDataFrame([(i, *r, "dna") for i, r in enumerate(rows)], "i int, row string, strand int, rotation int, read_index array<int>, source string, saved string, molecule string")
    got = {r.i: (r.bases, r.origin, r.lost) for r in alignment.rebuild(df).collect()}
    assert got == {0: (read, "source", 0), 1: (read, "saved", 0), 2: (turned, "row", 0), 3: ("TAGG", "row", 4)}
    assert alignment.read_order_one("GGTA", [6, 7, 1, 2]) == ("TAGG", 4, [2, 3, 0, 1])


def test_occurrences_equal_brute_force(spark):
    """Overlaps, periodic texts, probes of one letter, letters beyond Latin-1, nulls; with the text around."""
    rng = random.Random(6)
    texts = [bases(rng, 60), "AT" * 40, "", None, "A", "é漢字ATGéATG漢", "ACGT" * 20 + "N"]
    probes = ["A", "AT" * 9, "TATATATATATAT", "ATG", "字ATG", "漢", "GTACGTACGTACG", "ACGTN", ""]
    t = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    p = spark.createDataFrame(list(enumerate(probes)), "q int, probe string")
    want = sorted((i, q, at) for i, x in enumerate(texts) for q, w in enumerate(probes) if w for at in range(len(x or "")) if x.startswith(w, at))
    rows = search.occurrences(t, "text", p, around=5).collect()
    assert sorted((r.i, r.q, r["at"]) for r in rows) == want
    assert all(texts[r.i][r["at"] - r._i :].startswith(r.chunk) and r.chunk.startswith(r.probe, r._i) and r._i == min(5, r["at"]) for r in rows)
    joined = search.PROBE_LETTERS
    try:
        search.PROBE_LETTERS = 1  # beyond it, probes are joined
        assert sorted((r.i, r.q, r["at"]) for r in search.occurrences(t, "text", p).collect()) == want
    finally:
        search.PROBE_LETTERS = joined


def test_search_of_a_periodic_text_ends_soon(spark):
    import time

    began = time.time()
    c = spark.createDataFrame([("f", "n", "AT" * 5000)], "file string, name string, sequence string")
    q = spark.createDataFrame([(i, "AT" * (10 + i % 7)) for i in range(200)], "query_id int, sequence string")
    assert search.exact_search(c, q).where("start < 3").count() > 0 and time.time() - began < 60
