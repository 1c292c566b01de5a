"""The per-cycle ingest: changed feeds in, stored
documents, extracts and models out.

The change stream feeds it: the polls of a cycle that bring new content name
articles, articles whose URL isn't stored become documents, their domains are
trained on, and every new document ends in the extracts or the rejects.  All
tables of a cycle become visible with its manifest, so a cycle that dies is as
if it had never begun, and a cycle is never taken twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import TRAIN_DOC_LIMIT
from ..operators import extract, keys
from ..operators.training import MODEL_TABLES, content_cycle
from ..sources.cycles import Attempt, CycleStore
from .feeds import FEED_TABLES, run_feed_stream

ARTICLES = "page_id long, url string, html string"
TABLES = MODEL_TABLES | {
    "documents": "page_id long, url string, domain string, html string",
    "quarantine": "page_id long, url string",
    "rejects": "page_id long, domain string, reason string",
}
#: Documents are looked up by URL: a cycle reads the buckets of its own URLs.
BUCKETS = {"documents": "url"}


def open_store(spark: SparkSession, path: str) -> CycleStore:
    return CycleStore(spark, path, FEED_TABLES | TABLES, BUCKETS)


def ingest_cycle(articles: DataFrame, store: CycleStore, attempt: Attempt, limit: int = TRAIN_DOC_LIMIT,
                 fetched: DataFrame | None = None) -> None:
    """One cycle over ``(page_id, url, html)``.  With ``fetched`` pages of the
    same columns ``articles`` may be bare links ``(page_id, url)``: markup is
    read for new documents only, not for every entry that lists them.

    Articles without a usable link go to ``quarantine``.  Of the rest, those
    whose URL is not stored yet (of repeats the lowest ``page_id``) become
    ``documents``.  Their domains are trained on their first ``limit`` documents
    in order of arrival; new documents' extracts go to ``extracts``, and those
    that give none, with the reason, to ``rejects``.
    """
    columns = ["page_id", "url"] + (["html"] if fetched is None else [])
    a = keys.netloc(articles.select(*columns)).withColumnRenamed("netloc", "domain")
    bad = F.col("url").isNull() | (F.coalesce("domain", F.lit("")) == "")
    attempt.put("quarantine", a.filter(bad))

    # of a URL that many entries repeat one row per task travels, without its markup
    first = a.filter(~bad).groupBy("url").agg(F.min("page_id").alias("page_id"))
    touched = [r.bucket for r in first.select(store.bucket("documents").alias("bucket")).distinct().collect()]
    done = store.table("documents", before=attempt.cycle).filter(F.col("bucket").isin(touched)).select("url")
    new = first.join(done, "url", "left_anti")
    found = a.filter(~bad) if fetched is None else \
        keys.netloc(fetched.select("page_id", "url", "html")).withColumnRenamed("netloc", "domain")
    docs = attempt.put("documents", found.join(new, ["url", "page_id"]).dropDuplicates(["url", "page_id"]))

    pages = docs.select("page_id", "domain")
    main = content_cycle(store, attempt, docs, limit)
    nodes = store.spark.read.schema(store.schemas["nodes"]).parquet(attempt.paths["nodes"])
    model = store.table("model", before=attempt.cycle).select("domain").unionByName(
        store.spark.read.schema(store.schemas["model"]).parquet(attempt.paths["model"]).select("domain"))
    attempt.put("rejects", extract.page_outcomes(pages, main, model, nodes).filter(~F.col("extracted")))


def run_ingest_stream(spark: SparkSession, polls_dir: str, entries: Callable[[DataFrame], DataFrame], store_dir: str,
                      checkpoint_dir: str, limit: int = TRAIN_DOC_LIMIT, fetched: DataFrame | None = None, **stream):
    """Poll files through change detection into :func:`ingest_cycle`.
    ``entries`` gives the articles ``(page_id, url, html)`` that changed polls
    list (a join with the fetched pages), or links into ``fetched`` pages."""
    def then(changes: DataFrame, store: CycleStore, attempt: Attempt) -> None:
        ingest_cycle(entries(changes.filter("changed")), store, attempt, limit, fetched)

    return run_feed_stream(spark, polls_dir, store_dir, checkpoint_dir, then=then, tables=TABLES, buckets=BUCKETS, **stream)


def run_article_stream(spark: SparkSession, source_dir: str, store_dir: str, checkpoint_dir: str,
                       files_per_cycle: int = 64, limit: int = TRAIN_DOC_LIMIT):
    """Article files through :func:`ingest_cycle`, at most ``files_per_cycle``
    files a cycle; processes what is there and stops."""
    store = open_store(spark, store_dir)

    def cycle(articles: DataFrame, number: int) -> None:
        attempt = store.begin(number)
        if attempt is not None:
            ingest_cycle(articles, store, attempt, limit)
            attempt.commit()

    src = spark.readStream.schema(ARTICLES).option("maxFilesPerTrigger", files_per_cycle).parquet(source_dir)
    return (src.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())
