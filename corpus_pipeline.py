"""A corpus from ``documents``: known language, good quality, one of each near-duplicate, no secrets, packed.

Each stage works on all rows that the one before kept, and is written as Parquet in between.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keyquarry.llm import languages, packing, perplexity, secret_ledger, simhash
from keyquarry.llm.common import remainder_is
from keyquarry.session import new_path, prepare


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; profiles and floors come from the labelled rows that are not held out."""
    labelled = docs.filter(~remainder_is("doc_id", 4, 2))
    return languages.keep_known(docs, languages.learn(labelled), allowed=languages.floors(labelled))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and lie in the perplexity band of their language."""
    return perplexity.keep_good(docs, in_files=True)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each class of near-duplicates."""
    return simhash.keep_one(docs, in_files=True)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced by a mark."""
    return secret_ledger.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 1024 tokens.  A Python process serves all stages, so it keeps few stretches, and none behind a task."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), most=100_000, together=1000)


def _prepared(stage):
    """The stage with this library's session settings (Arrow batches bounded in bytes), also where it is called alone."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(prepare(spark), docs, sf_dir)

    return run


STAGES = [(name, _prepared(stage)) for name, stage in (
    ("language_id", known_language),
    ("quality_rules", good_quality),
    ("near_dedup", one_of_each),
    ("secret_scan", without_secrets),
    ("packing", packed),
)]

#: Language profiles, perplexity and tokens are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the packed pieces."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
