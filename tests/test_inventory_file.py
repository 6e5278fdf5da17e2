import os

import pytest

from seqweave.operators import inventory
from seqweave.sources import inventory_file as I
from seqweave.sources.formats import write_sheet

ROWS = [["Oligo", "Bases", "Box", "", "Box"], ["a", "ac gt", "1", "x", "2"], ["none", " ", "3"], ["b", "ACGT"]]


def test_status_of_files(spark, tmp_path):
    assert I.load(spark, None).status == "disabled"
    assert I.load(spark, str(tmp_path / "gone.csv")).status == "missing"
    for name, data in (("~$x.xlsx", b"x"), ("a.pdf", b"x"), ("broken.xlsx", b"x"), ("empty.csv", b""), ("narrow.csv", b"only\n")):
        (tmp_path / name).write_bytes(data)
        assert I.load(spark, str(tmp_path / name)).status == "error", name


@pytest.mark.parametrize("name", ["i.csv", "i.tsv", "i.xlsx"])
def test_entries(spark, tmp_path, name):
    sep = "\t" if name.endswith("tsv") else ","
    data = write_sheet(ROWS) if name.endswith("xlsx") else "\r\n".join(sep.join(r) for r in ROWS).encode("utf-8-sig")
    (tmp_path / name).write_bytes(data)
    inv = I.load(spark, str(tmp_path / name), "oligo", "BASES")
    assert (inv.status, inv.extra_columns) == ("ok", ["Box"])
    rows = inv.entries.orderBy("row_no").collect()
    assert [(r.name, r.sequence, r.extra["Box"]) for r in rows] == [("a", "ac gt", "1"), ("b", "ACGT", "")]
    assert tuple(inventory.load_result(inv.entries).first()) == (2, 1, 1)
    assert "not found" in I.load(spark, str(tmp_path / name), "nope").message


def test_a_file_is_read_again_only_when_it_changes(spark, tmp_path):
    path = tmp_path / "i.csv"
    path.write_text("name,seq\na,ACGT\n")
    loader = I.Loader(spark, most=2)
    first = loader.load(str(path), "name", "seq")
    assert first.status == "ok" and loader.load(str(path), "name", "seq") is first and loader.read == 1
    assert loader.load(str(path), "name", "nope").status == "error" and loader.read == 2
    assert loader.load(str(path), "name", "nope").status == "error" and loader.read == 2
    path.write_text("name,seq\na,ACGT\nb,GG\n")
    again = loader.load(str(path), "name", "seq")
    assert again is not first and again.entries.count() == 2 and loader.read == 3
    os.utime(path, (1, 1))
    assert loader.load(str(path), "name", "seq") is not again and loader.read == 4
    path.unlink()
    assert loader.load(str(path), "name", "seq").status == "missing"
    assert loader.load(None).status == "disabled"


def test_reads_are_capped_in_natural_order(spark):
    df = spark.createDataFrame([("r10",), ("r2",), ("r1",)], "name string")
    kept, left = I.capped_reads(df, most=2)
    assert [r.name for r in kept.collect()] == ["r1", "r2"] and left == 1
