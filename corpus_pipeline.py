"""The corpus pipeline: documents in, packed token sequences out. Each stage works on all that the one before kept.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further columns of any
name, and says below what becomes of them. An empty table gives an empty table throughout. ``docs`` has to be a table (read
from files), as some stages scan it more than once.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import exact_dedup, langid, minhash, packing, suffix_dedup
from lectern.llm.common import durable, passing, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; the classifier learns from a bounded sample of the labelled rows. Null texts, texts
    without a letter and, where no row has a label, all rows are rejected; repeated rows stay or go together."""
    return langid.keep_known(docs, langid.learn(docs))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty) the row of the largest id stays; of rows that repeat text and id, one."""
    return exact_dedup.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays, that of the smallest id. Texts without a
    word and rows without an id stay; rows that repeat an id stay or go together."""
    return minhash.keep_one_of_near(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes and more that a document of a smaller id has; every document stays. Null texts
    become empty, n_chars follows the text; rows without an id, and rows of one id among each other, lose nothing."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = suffix_dedup.cut_repeats(docs, keep_text=True, extra=rest)
    cut = cut.withColumnRenamed("kept", "text")
    if "n_chars" in rest:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4,096 tokens; empty texts are one token, repeated rows are packed as
    often as they occur."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup_stage),
    ("best_fit_packing", best_fit_packing),
]

#: Compression, minimum hashes and packing have no SQL form; tests/llm holds the run against brute force.
ORACLE_SQL = None


def _after(spark: SparkSession, sf_dir: str, stages: list) -> DataFrame:
    """The documents after the last of some stages, as a table; those before go once it is written."""
    if not stages:
        return table(spark, sf_dir, "documents")
    name, stage = stages[-1]
    with passing(spark, f"stage-{name}"):
        return durable(stage(spark, _after(spark, sf_dir, stages[:-1]), sf_dir), f"stage-{name}")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, _after(spark, sf_dir, STAGES[:-1]), sf_dir)
