"""The k-mer index against a full scan, while files change, go and come, and batches are repeated."""

import os
import random

import pytest

from seqweave.operators import search
from seqweave.streaming import index


def record(bases):
    return "LOCUS       x\nORIGIN\n        1 " + bases.lower() + "\n//\n"


def scanned(spark, texts, queries):
    corpus = spark.createDataFrame([(p, "", t) for p, t in texts.items()], "file string, name string, sequence string")
    return sorted((r.query_id, r.file, r.start, r.end, r.strand) for r in search.exact_search(corpus, queries).collect())


def searched(spark, folder, queries):
    return sorted((r.query_id, os.path.basename(r.path), r.start, r.end, r.strand) for r in index.search(spark, folder, queries).collect())


def test_index_follows_changes_like_a_full_scan(spark, tmp_path):
    rng = random.Random(5)
    folder, at = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()
    texts = {f"f{i}.gb": "".join(rng.choice("ACGT") for _ in range(n)) for i, n in enumerate((900, 530, 512, 40, 5))}
    texts["poly [a].gb"] = "A" * 700 + "CNRA"
    texts["none.gb"] = ""
    one = texts["f0.gb"]
    words = [one[100:160], one[505:529], one[:12], one[-12:], one[-3:], texts["f4.gb"], "A" * 30, "A" * 13, "AC", "C", "CNR", "ANR" * 5, "", "Z", one]
    queries = spark.createDataFrame(list(enumerate(words)), "query_id int, sequence string")

    def write(name):
        (folder / name).write_text(record(texts[name]))

    for name in texts:
        write(name)
    assert index.refresh(spark, str(folder), at, files=3) == {"read": 7, "reused": 0, "gone": 0}
    assert searched(spark, at, queries) == scanned(spark, texts, queries)

    texts["f1.gb"] = one[90:400] + "ACGT"
    texts["poly [a].gb"] = "G" * 50 + one[100:160]
    for name in ("f1.gb", "poly [a].gb"):
        write(name)
    del texts["f2.gb"]
    (folder / "f2.gb").unlink()
    assert index.refresh(spark, str(folder), at) == {"read": 2, "reused": 4, "gone": 1}
    after = scanned(spark, texts, queries)
    assert searched(spark, at, queries) == after
    assert index.refresh(spark, str(folder), at) == {"read": 0, "reused": 6, "gone": 0}

    index.compact(spark, at)
    assert searched(spark, at, queries) == after
    index.vacuum(spark, at)
    assert not (tmp_path / "index" / "0").exists() and searched(spark, at, queries) == after
    assert {os.path.basename(r.path): r.sequence for r in index.current(spark, at).collect()} == texts
    assert index.refresh(spark, str(folder), at) == {"read": 0, "reused": 6, "gone": 0}


def test_a_repeated_batch_counts_once_and_a_broken_one_not_at_all(spark, tmp_path):
    at = str(tmp_path / "index")
    schema = "path string, mtime timestamp, size long, sequence string"
    rows = spark.createDataFrame([("a", None, 1, "ACGTACGTACGTAC"), ("b", None, 1, None)], schema)
    assert index.upsert(rows, at, "s", 0) and not index.upsert(rows, at, "s", 0)
    assert index.upsert(rows, at, "t", 0)
    queries = spark.createDataFrame([(1, "ACGTACGTACGT")], "query_id int, sequence string")
    assert [r.start for r in index.search(spark, at, queries).collect()] == [0]
    # Folders of a commit that never was marked.
    for table in ("texts", "kmers"):
        os.rename(f"{at}/0/{table}/commit=2", f"{at}/0/{table}/commit=7")
    assert [(r.path, r.commit) for r in index.live(spark, at).collect()] == [("a", 1)]
    index.compact(spark, at)
    assert not index.upsert(rows, at, "s", 0) and index.upsert(rows, at, "s", 1)
    assert [r.start for r in index.search(spark, at, queries).collect()] == [0]


def test_search_opens_only_the_partitions_of_its_tiles(spark, tmp_path):
    at = str(tmp_path / "index")
    rng = random.Random(6)
    text = "".join(rng.choice("ACGT") for _ in range(5000))
    index.upsert(spark.createDataFrame([("a", None, 1, text)], "path string, mtime timestamp, size long, sequence string"), at)
    probes = spark.createDataFrame([("ACGTTTGCAACG",)], "probe string")
    wanted = index._kmers(spark, at, index.tiles(probes))
    opened = {r[0] for r in wanted.select("_metadata.file_path").distinct().collect()}
    assert opened and all("/lead=ACG/" in f for f in opened)
    assert "PartitionFilters: [isnotnull(lead" in wanted._jdf.queryExecution().executedPlan().toString()
    assert index.search(spark, str(tmp_path / "none"), spark.createDataFrame([(1, "ACG")], "query_id int, sequence string")).count() == 0


@pytest.mark.parametrize("n", [12, 13, 23, 24, 25, 40])
def test_tiles_cover_a_probe(spark, n):
    rows = index.tiles(spark.createDataFrame([("x" * n,)], "probe string")).collect()
    assert {i for r in rows for i in range(r.off, r.off + index.K)} == set(range(n))
    assert {r.n_tiles for r in rows} == {len(rows)}


def test_a_letter_is_in_one_row_of_the_index_and_short_and_long_probes_are_found(spark, tmp_path):
    at, rng = str(tmp_path / "index"), random.Random(8)
    texts = {f"t{n}": "".join(rng.choice("AC") for _ in range(n)) for n in (1, 11, 12, 13, 505, 1500)}
    index.upsert(spark.createDataFrame([(p, None, 1, t) for p, t in texts.items()], "path string, mtime timestamp, size long, sequence string"), at)
    assert spark.read.parquet(f"{at}/0/kmers").count() == sum(-(-len(t) // index.K) for t in texts.values())
    cuts = [texts["t1500"][i : i + n] for n in (5, 22, 23, 47) for i in (0, 1, 11, 495, 503, 1500 - n)]
    queries = spark.createDataFrame(list(enumerate(cuts)), "query_id int, sequence string")
    assert searched(spark, at, queries) == scanned(spark, texts, queries)
