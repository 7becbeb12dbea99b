"""Cleaning pipeline over ``documents``: a stage is written as Parquet and read by the next.

All stages but the last keep the columns of ``documents``. Null and empty texts end at the first
stage (no language); repeated rows end at the second; columns beyond those of ``documents`` are
carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm import bpe, ppm, secrets, simhash, wumanber
from bazaarlens.llm.common import staged, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the labelled rows that are not held out."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(-1))
    return ppm.in_known_language(docs, ppm.train(docs.where(fold != 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return wumanber.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; values copied by many sources are examples and stay."""
    return secrets.masked_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: their number and digests of ids and decoded bytes."""
    encoder = bpe.Bpe(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return bpe.round_trip(docs, encoder)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("tokens", tokens),
]

# SQL cannot express the fingerprints, context trees and merges; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
