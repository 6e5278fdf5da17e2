"""A training corpus from raw documents, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns of documents.

Toxic documents go; one of each group of equal texts stays, then one of each group of near duplicates; sources are mixed
to their targets, with a row for each time a document is taken; the mixed documents are encoded.

Every stage takes nulls in any column, empty and very long texts, repeated rows, rows of one id with other texts, an empty
table, and columns beside those of documents, which it keeps.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seqweave.llm import bpe, common, exact_dedup, mixing, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words, null texts among them, stay; rows alike share their fate; without labels of both classes all stay."""
    return toxicity.keep_clean(docs, common.read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts are empty, and empty texts copies of each other; of ties in length the least id stays, a null id last."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of each group of near copies stays, a null id last; texts without words are near copies of each other."""
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words aren't taken; a null source is one of its own, weighted last; rows alike share what is taken."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts are empty and have no ids; a row for each row."""
    return bpe.encode_digests(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Kernels, fingerprints' components and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
