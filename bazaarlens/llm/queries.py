"""Registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm import (
    audit,
    bpe,
    licences,
    multiset,
    planes,
    ppm,
    quality,
    rollup,
    secrets,
    simhash,
    toxicity,
    warc,
    wumanber,
)
from bazaarlens.llm.common import staged, table
from bazaarlens.llm.oracles import ORACLES  # noqa: F401  (registered with the queries)
from bazaarlens.session import work_dir


def _fold(parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in fold -1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts, F.lit(-1))


#: What the revision of op1 replaces by a space: runs of symbols from table and markup debris.
DEBRIS = r"[#*%&$!|]+"


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Totals after four batches over ``docs``, kept below ``path``: load, removal of exact copies,
    revised counts of cleaned texts, and a second tokenizer version; two of them are committed twice.

    Null texts are empty texts and copies of each other. Of rows with one text that with the smallest
    id stays (all of them if its id is repeated); rows without an id stay only if no row of that text
    has one. Null sources and languages are keys of their own. An empty table gives no totals.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    clean = F.regexp_replace(text, DEBRIS, " ")
    counted = staged(
        docs.select(
            "doc_id", "source", "lang", F.sha2(text, 256).alias("digest"),
            *[
                rollup.word_count(own, version).alias(f"{name}_{version[-1]}")
                for name, own in (("raw", text), ("clean", clean)) for version in rollup.WORDS
            ],
            F.char_length(text).cast("bigint").alias("raw_chars"),
            F.char_length(clean).cast("bigint").alias("clean_chars"),
            (text != clean).alias("changed"),
        ),
        "token-counts",
    )
    first = staged(counted.groupBy("digest").agg(F.min("doc_id").alias("first")), "first-copies")
    # joined once for all batches
    marked = staged(
        counted.join(first, "digest").select(
            *[c for c in counted.columns if c not in ("doc_id", "digest")],
            (~F.col("doc_id").eqNullSafe(F.col("first"))).alias("copy"),
        ),
        "marked-copies",
    )

    def rows(name: str, version: str, condition: str = "true") -> DataFrame:
        return marked.where(condition).select(
            "source", "lang", F.lit(version).alias("tokenizer"),
            F.col(f"{name}_{version[-1]}").alias("n_tokens"),
            F.col(f"{name}_chars").alias("n_chars"),
        )

    kept, edited = "NOT copy", "NOT copy AND changed"
    batches = {
        "load": rollup.signed(rows("raw", "words@1"), 1),
        "copies": rollup.signed(rows("raw", "words@1", "copy"), -1),
        "clean": rollup.revised(rows("raw", "words@1", edited), rows("clean", "words@1", edited)),
        "second-version": rollup.signed(rows("clean", "words@2", kept), 1),
    }
    totals = rollup.TokenRollup(docs.sparkSession, path)
    for name in ("load", "copies", "copies"):
        totals.commit(name, batches[name])
    totals.compact()
    for name in ("copies", "clean", "second-version", "clean"):
        totals.commit(name, batches[name])
    return totals.totals()


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), work_dir(spark, "rollup"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ppm.train(docs.where(_fold(4) != 2))
    return ppm.identify(docs, model).withColumn("held_out", _fold(4) == 2)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = bpe.Bpe(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return bpe.round_trip(table(spark, sf_dir, "documents"), encoder)


def op6_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.fingerprints(table(spark, sf_dir, "documents"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.train(docs))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = _fold(3) != 1
    labels = table(spark, sf_dir, "labels").where(learn)
    model = quality.train(docs.where(learn), labels)
    return quality.score(docs, model).withColumn("held_out", _fold(3) == 1)


def op10_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wumanber.decontaminate(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = _fold(5) != 0
    labels = table(spark, sf_dir, "labels").where(learn)
    model = toxicity.train(docs.where(learn), labels)
    return toxicity.score(docs, model).withColumn("held_out", _fold(5) == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_language_id": op2_language_id,
    "op3_warc": op3_warc,
    "op4_secrets": op4_secrets,
    "op5_bpe": op5_bpe,
    "op6_multiset": op6_multiset,
    "op7_licences": op7_licences,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_wu_manber": op10_wu_manber,
    "op11_toxicity": op11_toxicity,
    "op12_filter_audit": op12_filter_audit,
    "op13_bit_planes": op13_bit_planes,
}
