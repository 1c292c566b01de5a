"""Feed polling: change detection in batch and as a stream.

A poll sends the feed's last validator; the server answers "not modified"
when its current validator equals it.  So a successful poll is *changed* when
its validator differs from the last one stored (or none is stored yet), and
then the stored validator is replaced (a missing one becomes ''); otherwise
it is *same*.  A failed poll is *unchanged* and keeps the stored validator.

Polls may carry two validators.  The stronger one decides: the etag, or where
there is none the Last-Modified value; an answer with neither can never be
"not modified", so such a poll is changed.

The stream holds polls in state until the watermark has passed their hour,
then hands them on, each once; cycles are in event-time order.  State is a window
aggregation by (hour, feed, poll), so rows stay in the JVM and a feed with a large
share of all polls is many state keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import POLL_SECONDS
from ..sources.cycles import Attempt, CycleStore

POLL_SCHEMA = T.StructType([
    T.StructField("feed_url", T.LongType()),
    T.StructField("poll_ts", T.TimestampType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("etag", T.StringType()),
])

VALIDATED_SCHEMA = T.StructType(POLL_SCHEMA.fields + [T.StructField("modified", T.StringType())])

CHANGE_SCHEMA = T.StructType(POLL_SCHEMA.fields + [
    T.StructField("status", T.StringType()),
    T.StructField("changed", T.BooleanType()),
    T.StructField("validator", T.StringType()),
])


def _validator(two: bool = False):
    """The validator of a successful poll; with ``two``, the stronger of etag
    and Last-Modified, or the poll itself, which equals nothing."""
    if not two:
        return F.when(F.col("ok"), F.coalesce(F.col("etag"), F.lit("")))
    tagged = [F.concat(F.lit(f"{name}:"), F.nullif(name, F.lit(""))) for name in ("etag", "modified")]
    return F.when(F.col("ok"), F.coalesce(*tagged, F.concat(F.lit("poll:"), F.col("event_id").cast("string"))))


def _label(prev, two: bool = False):
    v = _validator(two)
    status = (F.when(~F.col("ok"), F.lit("unchanged"))
              .when(prev.isNull() | (v != prev), F.lit("changed"))
              .otherwise(F.lit("same")))
    after = F.when(status == "changed", v).otherwise(prev)
    return status, after


def feed_changes(polls: DataFrame, chunk: str = "1 hour", stored: DataFrame | None = None) -> DataFrame:
    """C1 over a poll table, as a two-phase prefix scan.

    A single feed may hold a large share of all polls, so the ordered scan is
    not run per feed: polls are cut into (feed, time chunk) pieces, each piece
    finds the last validator before every poll locally, a small per-piece
    table carries the last validator of all earlier pieces forward, and the
    two are combined.  Work per task is bounded by the chunk size.

    Polls with a ``modified`` column are compared by both validators.
    ``stored`` (``feed_url``, ``validator``) holds what earlier polls left.
    """
    two = "modified" in polls.columns
    p = polls.withColumn("_chunk", F.date_trunc("hour", "poll_ts") if chunk == "1 hour"
                         else F.window("poll_ts", chunk).start)
    order = [F.col("poll_ts"), F.col("event_id")]
    w_local = (Window.partitionBy("feed_url", "_chunk").orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("_local", F.last(_validator(two), ignorenulls=True).over(w_local))
    last_in_chunk = (p.groupBy("feed_url", "_chunk")
                     .agg(F.max_by(_validator(two), F.when(F.col("ok"), F.struct(*order))).alias("_last")))
    w_carry = Window.partitionBy("feed_url").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = last_in_chunk.withColumn("_carry", F.last("_last", ignorenulls=True).over(w_carry)) \
                         .select("feed_url", "_chunk", "_carry")
    p = p.join(carry, ["feed_url", "_chunk"])
    prev = F.coalesce(F.col("_local"), F.col("_carry"))
    if stored is not None:
        p = p.join(stored.select("feed_url", F.col("validator").alias("_stored")), "feed_url", "left")
        prev = F.coalesce(prev, F.col("_stored"))
    status, after = _label(prev, two)
    columns = [c.name for c in (VALIDATED_SCHEMA if two else POLL_SCHEMA).fields]
    return p.select(*columns, status.alias("status"), (status == "changed").alias("changed"), after.alias("validator"))


def last_validators(changes: DataFrame) -> DataFrame:
    """What each feed's polls leave stored: ``(feed_url, validator)``."""
    return changes.groupBy("feed_url").agg(
        F.max_by("validator", F.struct("poll_ts", "event_id")).alias("validator"))


def changed_feeds(changes: DataFrame) -> DataFrame:
    """C3 first step: the polls that bring new content."""
    return changes.filter("changed")


def dedupe_polls(polls: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """C4: never process a poll twice -- in-batch repeats and polls already
    in the output are dropped."""
    p = polls.dropDuplicates(["event_id"])
    if done is not None:
        p = p.join(done.select("event_id"), "event_id", "left_anti")
    return p


# ------------------------------------------------------------------ stream

PIECE = "1 hour"
POLL_COLUMNS = [f.name for f in VALIDATED_SCHEMA.fields]


def ordered_polls(polls_stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each poll once, when its hour is complete.  Polls later than ``delay``
    behind the latest one seen are dropped once the watermark has passed their
    hour.  Of repeats inside an hour the first to arrive counts."""
    if "modified" not in polls_stream.columns:
        polls_stream = polls_stream.withColumn("modified", F.lit(None).cast("string"))
    # rows without a feed, an id or a time only move the watermark (one condition that reads the
    # event time, since others would be pushed below the watermark)
    whole = F.concat(*[F.col(c).cast("string") for c in ("poll_ts", "feed_url", "event_id")]).isNotNull()
    rest = [c for c in POLL_COLUMNS if c not in ("feed_url", "event_id")]
    held = (polls_stream.select(*POLL_COLUMNS).withWatermark("poll_ts", delay)
            .filter(whole).withColumn("ok", F.coalesce("ok", F.lit(False)))
            .groupBy(F.window("poll_ts", PIECE), "feed_url", "event_id").agg(F.first(F.struct(*rest)).alias("poll")))
    return held.select("feed_url", "event_id", "poll.*").select(*POLL_COLUMNS)


FEED_TABLES = {
    "polls": "feed_url long, poll_ts timestamp, event_id long, ok boolean, etag string, modified string",
    "changes": "feed_url long, poll_ts timestamp, event_id long, ok boolean, etag string, modified string, "
               "status string, changed boolean, validator string",
    "validators": "feed_url long, validator string",
}


def change_cycle(closed: DataFrame, store: CycleStore, attempt: Attempt) -> DataFrame:
    """One cycle of ordered polls: their changes, and the validators that every
    feed has then (a snapshot)."""
    known = store.table("validators", before=attempt.cycle, latest=True)
    changes = attempt.put("changes", feed_changes(closed, stored=known))
    new = last_validators(changes).withColumnRenamed("validator", "_new")
    # a feed whose polls all failed keeps what it had, which may be nothing
    attempt.put("validators", known.join(new, "feed_url", "full").select(
        "feed_url", F.coalesce("_new", "validator").alias("validator")))
    return changes


def run_feed_stream(spark: SparkSession, source_dir: str, store_dir: str, checkpoint_dir: str,
                    available_now: bool = True, poll_seconds: int = POLL_SECONDS, delay: str = "1 hour",
                    files_per_cycle: int = 64, then=None, tables: dict[str, str] | None = None,
                    buckets: dict[str, str] | None = None):
    """Poll files -> ordered polls -> one committed cycle per micro-batch.

    ``available_now`` processes what is there and stops (tests, backfills);
    otherwise the query fires every ``poll_seconds`` like the original loop.
    ``then(changes, store, attempt)`` adds more tables to the same cycle.  A
    cycle that is asked for again does nothing when it was committed, and
    starts afresh when it died before.
    """
    store = CycleStore(spark, store_dir, FEED_TABLES | (tables or {}), buckets)

    def cycle(closed: DataFrame, number: int) -> None:
        attempt = store.begin(number)
        if attempt is None:
            return
        # the stateful plan runs once: everything else reads what it wrote
        polls = attempt.put("polls", closed)
        if polls.isEmpty():
            return
        changes = change_cycle(polls, store, attempt)
        if then is not None:
            then(changes, store, attempt)
        attempt.commit()

    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = (spark.readStream.schema(VALIDATED_SCHEMA).option("maxFilesPerTrigger", files_per_cycle)
           .option("recursiveFileLookup", "true").parquet(source_dir))
    w = ordered_polls(src, delay).writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{poll_seconds} seconds")
    return w.start()


def end_mark(spark: SparkSession, source_dir: str, after: str) -> None:
    """Adds a poll of no feed ``after`` a time, which lets the watermark pass
    all earlier hours (a finite backfill has no later polls to do that)."""
    spark.createDataFrame([(None, None, None, False, None, None)], VALIDATED_SCHEMA) \
        .withColumn("poll_ts", F.expr(f"timestamp '{after}' + interval 1 day")).select(*POLL_COLUMNS) \
        .coalesce(1).write.mode("append").parquet(source_dir)
