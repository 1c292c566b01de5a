"""The feed stream against the batch form: late, repeated and hot polls, cycles that die."""

import random

import pytest
from pyspark.sql import functions as F

from pathsift.streaming import feeds

pytestmark = pytest.mark.usefixtures("few_partitions")

T0 = "2024-03-01 00:00:00"


def polls(spark, n=400, seed=1):
    """Two hot feeds, both kinds of validators, missing ones, failed polls."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        feed = rnd.choice([1, 1, 1, 2, 2, 3, 4, 5])
        ok = rnd.random() > 0.2
        etag = rnd.choice(["a", "b", "", None]) if ok and feed in (1, 3) else None
        modified = rnd.choice(["Mon", "Tue"]) if ok and feed in (2, 3) else None
        rows.append((feed, rnd.randrange(6 * 3600), i, ok, etag, modified))
    df = spark.createDataFrame(rows, "feed_url long, s long, event_id long, ok boolean, etag string, modified string")
    return df.select("feed_url", F.expr(f"timestamp '{T0}' + make_interval(0,0,0,0,0,0,s)").alias("poll_ts"),
                     "event_id", "ok", "etag", "modified").cache()


def run(spark, tmp_path, **kw):
    feeds.run_feed_stream(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ck"), **kw).awaitTermination()
    return feeds.CycleStore(spark, str(tmp_path / "store"), feeds.FEED_TABLES | kw.get("tables", {}))


def rows_of(df):
    return sorted((r.event_id, r.status, r.changed, r.validator) for r in df.collect())


def drop(df, tmp_path):
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_late_and_repeated_polls_give_the_batch_rows(spark, tmp_path):
    """Three batches; each holds polls up to 50 minutes older than the last one's, and repeats."""
    p = polls(spark)
    late = F.pmod(F.xxhash64("event_id"), F.lit(3000))
    arrives = F.unix_timestamp("poll_ts") - F.unix_timestamp(F.lit(T0)) + late
    for k in range(3):
        part = p.filter((arrives >= 8000 * k) & (arrives < (8000 * (k + 1) if k < 2 else 10 ** 6)))
        drop(part.unionByName(part.sample(0.3, seed=k)), tmp_path)
        run(spark, tmp_path)
    feeds.end_mark(spark, str(tmp_path / "in"), "2024-03-02 00:00:00")
    store = run(spark, tmp_path)
    assert rows_of(store.table("changes")) == rows_of(feeds.feed_changes(p))
    before = store.manifests()
    assert len(before) > 1 and rows_of(run(spark, tmp_path).table("changes")) == rows_of(feeds.feed_changes(p))
    latest = {r.feed_url: r.validator for r in store.table("validators", latest=True).collect()}
    assert latest == {r.feed_url: r.validator for r in feeds.last_validators(feeds.feed_changes(p)).collect()}


def test_held_polls_need_no_python_and_the_first_of_repeats_counts(spark, tmp_path):
    """rows of the state never pass through Python workers."""
    stream = spark.readStream.schema(feeds.VALIDATED_SCHEMA).parquet(str(tmp_path))
    plan = feeds.ordered_polls(stream)._jdf.queryExecution().logical().toString()
    assert "Aggregate" in plan and "Python" not in plan and "Pandas" not in plan
    one = polls(spark, 1).select("feed_url", "poll_ts", F.lit(7).cast("long").alias("event_id"), F.lit(True).alias("ok"), "etag", "modified")
    drop(one.withColumn("etag", F.lit("x")), tmp_path)
    run(spark, tmp_path)
    drop(one.withColumn("etag", F.lit("y")), tmp_path)
    feeds.end_mark(spark, str(tmp_path / "in"), "2024-03-02 00:00:00")
    assert [(r.event_id, r.etag) for r in run(spark, tmp_path).table("changes").collect()] == [(7, "x")]


def test_both_validators(spark):
    rows = [(1, 1, True, "x", "Mon"), (1, 2, True, "x", "Tue"), (1, 3, True, None, "Tue"), (1, 4, True, "", "Tue"),
            (1, 5, False, None, None), (1, 6, True, None, None), (1, 7, True, None, None), (1, 8, True, "x", None)]
    df = spark.createDataFrame(rows, "feed_url long, event_id long, ok boolean, etag string, modified string") \
        .withColumn("poll_ts", F.expr(f"timestamp '{T0}' + make_interval(0,0,0,0,0,event_id,0)"))
    got = {r.event_id: r.status for r in feeds.feed_changes(df).collect()}
    assert [got[k] for k in range(1, 9)] == ["changed", "same", "changed", "same", "unchanged", "changed", "changed", "changed"]


def test_a_cycle_that_dies_leaves_nothing_and_starts_afresh(spark, tmp_path):
    drop(polls(spark, 60), tmp_path)
    feeds.end_mark(spark, str(tmp_path / "in"), "2024-03-02 00:00:00")
    extra = {"tables": {"seen": "event_id long"}}
    deaths = []

    def then(changes, store, attempt):
        attempt.put("seen", changes.select("event_id"))
        if not deaths:
            deaths.append(1)
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(spark, tmp_path, then=then, **extra)
    store = feeds.CycleStore(spark, str(tmp_path / "store"), feeds.FEED_TABLES | extra["tables"])
    assert store.manifests() == [] and store.table("seen").isEmpty()
    store = run(spark, tmp_path, then=then, **extra)
    assert sorted(r.event_id for r in store.table("seen").collect()) == list(range(60))
    assert rows_of(store.table("changes")) == rows_of(feeds.feed_changes(polls(spark, 60)))


def test_store_errors_are_not_empty_tables(spark, tmp_path):
    (tmp_path / "store" / "manifests" / "cycle=0").mkdir(parents=True)
    (tmp_path / "store" / "manifests" / "cycle=0" / "part.json").write_text('{"cycle":0,"tables":{"changes":"/nowhere/at/all"}}')
    store = feeds.CycleStore(spark, str(tmp_path / "store"), feeds.FEED_TABLES)
    with pytest.raises(Exception, match="nowhere"):
        store.table("changes").collect()
