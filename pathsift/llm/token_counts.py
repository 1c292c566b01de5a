"""Operator 4, token counts through a digest cache.

Every text is reduced to the SHA-256 of its normalised content.  The distinct
digests are joined to the stored counts of the same tokenizer version; only
digests without a stored count are encoded, once each, and their counts are
appended to the cache.  Documents then take their count from the cache.

Shuffles: one of the distinct texts (after map-side de-duplication, so a text
that a third of the rows share moves once per task) and one of the narrow
(id, digest) rows.

Defined results: null or empty text has 0 bytes and 0 tokens; repeated rows
each return a row; a null id stays null; an empty table returns no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, version_digest

CACHE_SCHEMA = "tokenizer_digest string, content_digest binary, n_tokens bigint"


def _same(c: Column) -> Column:
    return c


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _encode(path: str, version: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = common.arrow_schema(CACHE_SCHEMA)

    def run(batches):
        enc = encoder(path)
        for b in batches:
            yield common.arrow_batch(
                schema, tokenizer_digest=[version] * b.num_rows, content_digest=b.column("content_digest"),
                n_tokens=[enc.count(t.as_py()) for t in b.column("text")])
    return run


def read_cache(spark, cache_path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per digest even if two
    jobs appended the same digest."""
    empty = spark.createDataFrame([], CACHE_SCHEMA)
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except Exception as e:  # only the absent first-run cache counts as empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = empty
    return (stored.filter(F.col("tokenizer_digest") == version)
            .groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")))


def refresh_cache(docs: DataFrame, cache_path: str, tokenizer: str,
                  normalise: Callable[[Column], Column] = _same) -> None:
    """Append the counts of texts whose digest the cache doesn't hold."""
    spark = docs.sparkSession
    common.arrow_rows(spark)
    version = version_digest(tokenizer)
    texts = common.id_and_text(docs).select(normalise(F.col("text")).alias("text"))
    distinct = (texts.withColumn("content_digest", digest_of(F.col("text")))
                .groupBy("content_digest").agg(F.first("text").alias("text")))
    misses = distinct.join(read_cache(spark, cache_path, version), "content_digest", "left_anti")
    (misses.select("content_digest", "text")
     .mapInArrow(_encode(tokenizer, version), CACHE_SCHEMA)
     .write.mode("append").parquet(cache_path))


def token_counts(docs: DataFrame, cache_path: str, tokenizer: str, limit: int = 1024,
                 normalise: Callable[[Column], Column] = _same) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``.

    ``normalise`` must keep the token count; the default leaves the text as it
    is, since byte-level vocabularies tell all texts apart."""
    spark = docs.sparkSession
    refresh_cache(docs, cache_path, tokenizer, normalise)
    keys = common.id_and_text(docs).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        digest_of(normalise(F.col("text"))).alias("content_digest"))
    # written, so that the join below reads plain rows and a hot digest can be split
    counts = common.saved(read_cache(spark, cache_path, version_digest(tokenizer)), "counts")
    return (keys.join(counts, "content_digest", "left")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
