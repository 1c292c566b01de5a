"""The stages of ``corpus_pipeline``: each applies one operator to all rows its
predecessor kept and lets the decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import default_tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores below 0.5 go."""
    from . import quality_fm
    model = quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(model.score(F.col("text")) >= 0.5)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays
    (null ids come last; of texts under one id, that of the least digest); of
    rows that share id and text, one.  A document that is alone stays, whatever
    its id; texts without words are near duplicates of none."""
    from . import jaccard_join
    text = F.coalesce("text", F.lit(""))
    number = F.col("doc_id").cast("long")
    key = F.unhex(F.md5(F.concat(F.coalesce(number.cast("string"), F.lit("")), F.lit("\n"), text)))
    kept = jaccard_join.first_keys(docs.select(number.alias("doc_id"), text.alias("text"), key.alias("key")))
    wordless = number.isNull() & ~text.rlike(r"[^\x20\x09-\x0D]")
    stay = docs.filter(~wordless).withColumn("_key", key).dropDuplicates(["_key"])
    stay = stay.join(kept, stay["_key"] == kept["key"], "left_semi").drop("_key")
    return stay.unionByName(docs.filter(wordless))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings are cut out; a document of which nothing
    stays goes, one that was empty before stays."""
    from . import suffix_dedup
    return suffix_dedup.cut_documents(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; they are told apart by id
    (null too) and text."""
    from . import decontaminate
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    found = decontaminate.matches(docs.select(key.alias("doc_id"), "text"),
                                  spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = common.saved(found.select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return docs.withColumn("_key", key).join(bad, "_key", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Optimal length buckets and token-budget batches of the remaining texts."""
    from .length_buckets import length_batches, token_lengths
    return length_batches(token_lengths(docs, default_tokenizer()))
