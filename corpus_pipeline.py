"""Corpus pipeline: quality filter, near-duplicates, PII, source mix, packing.

``STAGES`` lists (name, function) in order; each function takes (spark, docs,
sf_dir) and works on everything its predecessor kept. All stages but the last
return the columns of ``documents``. ``run`` applies them to the documents
table, with every stage written as Parquet and read again.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from threatsift.llm import jaccard, mixing, packing, pii, quality  # noqa: E402
from threatsift.llm.common import prepare, read_table, staged  # noqa: E402


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    prepare(spark)
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: shingles of five words,
    similarity 0.8 or more (the query op8 has its own, narrower constants)."""
    prepare(spark)
    return jaccard.keep_one(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by marks."""
    prepare(spark)
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out to meet the sources' target shares."""
    prepare(spark)
    return mixing.repeat_rows(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of bounded length."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("source_mixing", source_mix),
    ("best_fit_packing", sequences),
]

# Trained classifiers and sketches are not SQL; the tests hold the stages
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
