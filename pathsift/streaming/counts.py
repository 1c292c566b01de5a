"""J2 and J4 kept up to date by cycle.

A document counts with its representative extract (longest, then lowest id).
A cycle of new extracts may give a document a better one; then the old topic and
day lose the document and the new ones gain it.  What is stored only grows:
``rep`` has each document's successive representatives, ``deltas`` the gains and
losses of each cycle, and the counts are their sums.  Documents are looked up by
hash bucket, and a cycle's extracts are reduced to one row per document before
anything is joined, so a document with very many extracts is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.cycles import Attempt, CycleStore

EXTRACTS = "extract_id long, document_id long, content_length int, main_topic int, extracted_at timestamp"
TABLES = {
    "rep": "document_id long, content_length int, extract_id long, main_topic int, day date",
    "deltas": "main_topic int, day date, n long",
}
BUCKETS = {"rep": "document_id"}


def open_store(spark: SparkSession, path: str) -> CycleStore:
    return CycleStore(spark, path, TABLES, BUCKETS)


def _best(rows: DataFrame, name: str) -> DataFrame:
    """The representative of each document as a struct (null lengths last)."""
    worth = F.struct((-F.coalesce("content_length", F.lit(-1))).alias("shorter"), "extract_id")
    value = F.struct("content_length", "extract_id", "main_topic", "day")
    return rows.groupBy("document_id").agg(F.min_by(value, worth).alias(name), F.min(worth).alias(f"{name}_worth"))


def count_cycle(extracts: DataFrame, store: CycleStore, attempt: Attempt) -> None:
    """Adds the extracts (:data:`EXTRACTS`) of one cycle."""
    new = _best(extracts.withColumn("day", F.to_date("extracted_at")), "new")
    touched = [r.b for r in new.select(store.bucket("rep").alias("b")).distinct().collect()]
    old = _best(store.table("rep", before=attempt.cycle).filter(F.col("bucket").isin(touched)), "old")
    both = new.join(old, new["document_id"].eqNullSafe(old["document_id"]), "left").drop(old["document_id"])
    better = both.filter(F.col("old").isNull() | (F.col("new_worth") < F.col("old_worth")))
    attempt.put("rep", better.select("document_id", "new.*"))
    gained = better.select(F.explode(F.array(F.struct(F.col("new").alias("at"), F.lit(1).cast("long").alias("n")),
                                             F.struct(F.col("old").alias("at"), F.lit(-1).cast("long").alias("n")))).alias("x"))
    gained = gained.filter("x.at IS NOT NULL").select("x.at.main_topic", "x.at.day", "x.n")
    attempt.put("deltas", gained.groupBy("main_topic", "day").agg(F.sum("n").alias("n")).filter("n != 0"))


def docs_per_topic(store: CycleStore) -> DataFrame:
    """J2 as of the last committed cycle."""
    return (store.table("deltas").groupBy("main_topic").agg(F.sum("n").alias("n_docs")).filter("n_docs != 0")
            .orderBy("main_topic"))


def docs_per_day(store: CycleStore) -> DataFrame:
    """J4 as of the last committed cycle."""
    return store.table("deltas").groupBy("main_topic", "day").agg(F.sum("n").alias("n_docs")).filter("n_docs != 0")


def run_counts_stream(spark: SparkSession, source_dir: str, store_dir: str, checkpoint_dir: str, files_per_cycle: int = 64):
    """Extract files through :func:`count_cycle`; processes what is there and stops."""
    store = open_store(spark, store_dir)

    def cycle(extracts: DataFrame, number: int) -> None:
        attempt = store.begin(number)
        if attempt is not None:
            count_cycle(extracts, store, attempt)
            attempt.commit()

    src = spark.readStream.schema(EXTRACTS).option("maxFilesPerTrigger", files_per_cycle).parquet(source_dir)
    return (src.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())
