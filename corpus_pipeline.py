"""A training corpus from raw documents: five stages, each one of the operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrank.llm import decontaminate, language_id, minhash_dedup, packing, pii
from spanrank.llm.common import Scratch, hidden, table
from spanrank.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    inner, named = hidden(docs, "text")
    return named(language_id.predict(inner, model).where(F.col("lang_pred") != language_id.UNKNOWN))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class (five words, similarity 0.8) stays: that with the least doc_id, rows without one last.

    Rows are told apart by a number of their own, so rows that share a doc_id or
    have none are judged by their texts like all others.
    """
    inner, named = hidden(docs, "doc_id", "text")
    rows = Scratch(spark, "near").save(inner.withColumn("_row", F.monotonically_increasing_id()))  # written, so a row keeps its number
    classes = minhash_dedup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), words=5, percent=80)
    members = classes.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_class")).join(rows.select("_row", "doc_id"), "_row")
    kept = members.groupBy("_class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_row")).alias("m")).select("m._row")
    return named(rows.join(kept, "_row", "left_semi"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten words or more of benchmark items are cut, documents made of them go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emails, addresses, cards and phone numbers are replaced by their kind."""
    return pii.redact(docs, pii.learn_patterns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1,024 tokens, with their token ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: The stages need EM, MinHash, an automaton and a tokenizer; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each written to the shared scratch folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            saved = scratch.save(out)
            scratch.drop(docs)
            docs = saved
    return out
