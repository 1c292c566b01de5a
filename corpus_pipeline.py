"""Corpus pipeline: quality classifier, n-gram Jaccard join, suffix-array
deduplication, benchmark decontamination, packing.

``STAGES`` names the stages; each takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next stage's
``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathsift.llm import common, stages

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", stages.quality_classifier),
    ("ngram_jaccard_join", stages.ngram_jaccard_join),
    ("suffix_array_dedup", stages.suffix_array_dedup),
    ("benchmark_decontamination", stages.benchmark_decontamination),
    ("packing", stages.packing),
]

#: The stages train a model, align texts and run dynamic programming, which SQL
#: can't express; tests/llm holds the pipeline to brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last stage's rows."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
