"""SQL functions against their column forms, and the table functions."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from seqweave.functions import sequences as S
from seqweave.functions.register import SCALARS, register

TEXTS = ["", None, "acgt", "AC GT\nU", "MKLV*", "ATGGCC", "GCGCGCAATT", "ACGTNRYKM-", "Z9 q!", "BC12", "a10b2", "-3.5e2 mM", "7", "AUG", "ACGTACGTACGTACGTACGT", "é"]
NUMBERS = [(0, 3, 60), (5, 2, 0), (None, 60, 60), (0, 60, 60), (0, 50, 90), (1, None, 4), (2, 1, None)]


@pytest.fixture(scope="module")
def functions(spark):
    register(spark)
    return spark


@pytest.mark.parametrize("scalar", SCALARS, ids=lambda s: s.name)
def test_each_function_equals_its_column_form(functions, scalar):
    arguments = [a.split() for a in scalar.arguments.split(",")]
    cells = {"STRING": "s", "BIGINT": "xyz", "INT": "xyz", "BOOLEAN": "t"}
    rows = [(s, *n, t) for s in TEXTS for n in NUMBERS for t in (True, False, None)]
    table = functions.createDataFrame(rows, "s string, x int, y int, z int, t boolean")
    numbers = iter("xyz")
    used = [next(numbers) if cells[kind] == "xyz" else cells[kind] for _, kind in arguments]
    if scalar.name == "derive_bases":
        table = table.where("x >= 0 and y >= 0")
    if scalar.name == "strand_word":
        table = table.select(F.explode(F.array(F.lit(-1), F.lit(1), F.lit(None))).alias("x"))
    got = table.select(F.expr(f"{scalar.name}({', '.join(used)})").alias("sql"), scalar.column(*map(F.col, used)).alias("form"))
    assert got.where("NOT (sql <=> form)").limit(3).collect() == [] and got.count() > 0


def test_frames_and_fasta_lines(functions):
    spark = functions
    row = spark.sql("SELECT f.* FROM VALUES ('ATGGCNTTA') t(s), LATERAL six_frames(s) f").collect()
    own = spark.createDataFrame([("ATGGCNTTA",)], "s string").select(*[S.translate_frame("s", o).alias(str(o + 1)) for o in range(3)]).first()
    assert {r.frame: r.protein for r in row if r.strand > 0} == {int(k): v for k, v in own.asDict().items()} and len(row) == 6
    lines = [("a", 1, "x"), ("a", 3, " AC"), ("a", 2, "> one"), ("a", 4, "GT "), ("a", 5, ">two"), ("a", 6, None), ("b", 1, ">"), ("c", 1, "ACGT")]
    spark.createDataFrame(lines, "path string, line_no int, line string").createOrReplaceTempView("lines")
    got = spark.sql("SELECT * FROM fasta_records(TABLE(lines))").collect()
    assert sorted(map(tuple, got)) == [("a", 0, "one", "ACGT"), ("a", 1, "two", ""), ("b", 0, "", "")]
    assert spark.sql("SELECT * FROM fasta_records(TABLE(SELECT * FROM lines WHERE false))").count() == 0
    with pytest.raises(AnalysisException, match="line_no"):
        spark.sql("SELECT * FROM fasta_records(TABLE(SELECT path, line FROM lines))").collect()


def test_files_by_a_lateral_call(functions):
    files = [("d/x.fa", bytearray(b">p\nMKLVEEFQ\n>q\nACGT\n")), ("x.ab1", bytearray(b"junk")), ("e.gb", None)]
    functions.createDataFrame(files, "path string, content binary").createOrReplaceTempView("files")
    got = functions.sql("SELECT path, t.* FROM files, LATERAL sequence_tracks(path, content) t").collect()
    assert [(r.name, r.molecule) for r in got if r.path == "d/x.fa"] == [("x · p", "protein"), ("x · q", "dna")]
    assert [r.molecule for r in got if r.path == "x.ab1"] == [None]
    with pytest.raises(AnalysisException, match="molecule"):
        functions.sql("SELECT t.* FROM files, LATERAL sequence_tracks(path, content, 'rna') t").collect()
