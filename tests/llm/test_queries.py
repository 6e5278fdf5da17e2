"""The registered queries against their SQL, and the pipeline's stages, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from seqweave.llm import common, exact_dedup, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toArrow(), con.sql(queries.oracle_sql()[name]).to_arrow_table()
    names = sorted(want.column_names)
    assert sorted(got.column_names) == names
    assert Counter(map(str, got.select(names).to_pylist())) == Counter(map(str, want.select(names).to_pylist()))


def test_every_contract_column(spark):
    columns = {
        "op3_toxicity": ["doc_id", "held_out", "score", "predicted"], "op6_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op8_simhash": ["doc_id", "fingerprint", "component_id"], "op9_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op10_html_text": ["page_id", "url", "text", "n_chars"],
    }
    for name, want in columns.items():
        df = queries.queries()[name](spark, SF)
        table = "pages" if "page_id" in want else "documents"
        assert df.columns[: len(want)] == want and df.count() == common.read(spark, SF, table).count()


def test_pipeline_stages_keep_whole_clean_documents(spark):
    docs = start = common.read(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in start.collect()}
    labelled = {r.doc_id: r.toxic for r in common.read(spark, SF, "labels").collect()}
    toxic = {i for i, t in labelled.items() if t}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == start.columns
        rows = docs.collect()
        assert all(r.text == texts[r.doc_id] for r in rows)
        if name == "toxicity":
            clean = set(labelled) - toxic
            assert len(clean & {r.doc_id for r in rows}) > 0.8 * len(clean)
        elif name != "mixing":
            assert len({r.doc_id for r in rows}) == len(rows)
            keys = [exact_dedup_key(r.text) for r in rows]
            assert len(keys) == len(set(keys))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_stages_on_hostile_rows(spark, hostile, tmp_path):
    """Nulls, ties, repeated and null ids, very long and empty texts, clashing columns: each stage on all that the one before keeps."""
    labels = [(1, 0), (2, 0), (7, 0), (9, 1), (12, 1), (None, 1), (14, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, before = hostile, Counter(r.text for r in hostile.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, str(tmp_path)), f"hostile-{name}")
        rows = docs.collect()
        assert docs.columns == hostile.columns and {r.text for r in rows} <= set(before)
        if name == "exact_dedup":
            assert sorted(exact_dedup_key(t) for t in {exact_dedup_key(x) for x in before}) == sorted(exact_dedup_key(r.text) for r in rows)
        elif name == "mixing":
            sizes = {t: len((t or "").split()) for t in before}
            taken = Counter(r.text for r in rows)
            assert max(taken.values()) <= 3 and sum(sizes[t] * n for t, n in taken.items()) > 0
        before = Counter(r.text for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count() > 0


def exact_dedup_key(text):
    return "".join((text or "").split())


def test_pipeline_survives_empty_tables(spark, tmp_path):
    for t in ("documents", "labels"):
        common.read(spark, SF, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert exact_dedup.RUN_BITS % exact_dedup.ROUND_BITS == 0
