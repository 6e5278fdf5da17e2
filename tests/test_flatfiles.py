"""Records read in byte ranges are those of the whole file, wherever the ranges are cut."""

import io
import random

import pytest
from pyspark.sql import functions as F

from seqweave.sources import flatfiles, formats


def genbank(rng, k):
    seq = "".join(rng.choice("acgt") for _ in range(rng.randint(0, 150)))
    return formats.write_genbank({"name": f"r{k}", "sequence": seq, "circular": k % 2 == 0, "features": [{"name": "LOCUS x", "type": "CDS", "start": 0, "end": 3, "strand": 1}]})


@pytest.mark.parametrize("size", [1, 7, 64, 333, 5000, 10**6])
def test_ranges_of_any_size_give_each_record_once(size, monkeypatch):
    rng = random.Random(size)
    monkeypatch.setattr(flatfiles, "CHUNK", rng.choice([5, 50, 1 << 20]))
    text = "junk before\n" + "".join(genbank(rng, k) for k in range(12)) + "LOCUS"
    for body, mark in ((text.encode(), b"LOCUS"), (b">a\nAC>GT\n>b\n\n>\nAC\n>c", b">"), (b"", b">"), (b"no record\n", b"LOCUS")):
        got = [r for a in range(0, len(body), size) for r in flatfiles.records(io.BytesIO(body), mark, a, min(len(body), a + size), len(body))]
        starts = [i for i in range(len(body)) if body.startswith(mark, i) and (i == 0 or body[i - 1 : i] == b"\n")]
        assert got == [(a, body[a:b]) for a, b in zip(starts, [*starts, len(body)][1:], strict=True)]


def test_files_cut_inside_records_equal_the_whole_files(spark, tmp_path):
    rng = random.Random(3)
    (tmp_path / "in" / ".hidden").mkdir(parents=True)
    texts = {f"f{i}.gb": "".join(genbank(rng, 10 * i + k) for k in range(rng.randint(0, 9))) for i in range(4)} | {"x.txt": "LOCUS no\n", ".hidden/y.gb": "LOCUS no\n"}
    for name, text in texts.items():
        (tmp_path / "in" / name).write_text(text)
    want = sorted((r["name"], r["sequence"], r["circular"]) for n, t in texts.items() if n.startswith("f") for r in formats.parse_genbank(t))
    for path in (str(tmp_path / "in"), f"file://{tmp_path}/in"):
        rows = flatfiles.read_records(spark, path, split_bytes=100)
        assert rows.rdd.getNumPartitions() > 4
        got = sorted((r["name"], r["sequence"], r["circular"]) for x in rows.collect() for r in formats.parse_genbank(x.text))
        assert got == want
        parts = formats.genbank_features(rows.select("path", "text"))
        assert parts.count() == len(want) and parts.where(F.col("name") != "LOCUS x").count() == 0
        bases = rows.select(formats.origin_bases("text").alias("s"))
        assert sorted(r.s for r in bases.collect()) == sorted(s for _, s, _ in want)
    assert flatfiles.read_records(spark, str(tmp_path / "in" / ".hidden"), "fasta").count() == 0
