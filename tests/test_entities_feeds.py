import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from pathsift.operators import dashboard, entities, text, topic_reports
from pathsift.sources.store import keyed_update
from pathsift.streaming import feeds


def test_islands(spark):
    rows = [(1, 0, p, f"T{p}", "PERSON") for p in [1, 2, 3, 7, 8]]
    t = spark.createDataFrame(rows, "doc_id long, sent int, pos int, token string, tag string")
    got = sorted(r.phrase for r in entities.merge_adjacent(t).collect())
    assert got == ["T1 T2 T3", "T7 T8"]


def test_entity_cleanup(spark):
    df = spark.createDataFrame([("['A', 'B']",), ("[]",), ("A,B",)], "ner string")
    out = {r.ner: r.ner_clean for r in entities.cleanup_entity_string(df).collect()}
    assert out == {"['A', 'B']": " B,A", "[]": "No NERs Recognized"}


def _polls(spark, etags):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, base + dt.timedelta(minutes=i), i, e != "error", None if e == "error" else e)
            for i, e in enumerate(etags)]
    return spark.createDataFrame(rows, feeds.POLL_SCHEMA)


def test_feed_change_sequence(spark):
    out = feeds.feed_changes(_polls(spark, ["1", "1", "error", "1", "2"])).orderBy("event_id").collect()
    assert [r.status for r in out] == ["changed", "same", "unchanged", "same", "changed"]
    assert [r.validator for r in out] == ["1", "1", "1", "1", "2"]


def test_feed_change_across_chunks(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, base + dt.timedelta(hours=3 * i), i, True, e) for i, e in enumerate(["a", "a", "b", "b"])]
    out = feeds.feed_changes(spark.createDataFrame(rows, feeds.POLL_SCHEMA)).orderBy("event_id").collect()
    assert [r.status for r in out] == ["changed", "same", "changed", "same"]


def test_stream_matches_batch_and_is_idempotent(spark):
    src = "/root/testdata/sf0.001/events.parquet"
    polls = spark.read.parquet(src).select(
        F.col("user_id").alias("feed_url"), F.col("ts").alias("poll_ts"), "event_id",
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k")).alias("etag"))
    work = tempfile.mkdtemp(prefix="feeds-")
    indir = os.path.join(work, "in")
    polls.withColumn("day", F.to_date("poll_ts")).write.partitionBy("day").parquet(indir)
    feeds.end_mark(spark, os.path.join(indir, "day=end"), "2024-03-01")
    out, ck = os.path.join(work, "out"), os.path.join(work, "ck")
    feeds.run_feed_stream(spark, indir, out, ck, delay="10 days").awaitTermination()
    store = feeds.CycleStore(spark, out, feeds.FEED_TABLES)
    first = store.table("changes")
    batch = feeds.feed_changes(polls.withColumn("modified", F.lit(None).cast("string")))
    cols = ["event_id", "status", "validator"]
    assert first.count() == batch.count()
    assert first.select(cols).exceptAll(batch.select(cols)).count() == 0
    feeds.run_feed_stream(spark, indir, out, ck, delay="10 days").awaitTermination()
    assert store.table("changes").count() == batch.count()


def test_corpus_since_keeps_old_rows_of_same_length(spark):
    rows = [(1, 1, 5, dt.datetime(2024, 1, 1)), (2, 1, 5, dt.datetime(2024, 2, 1)), (3, 1, 3, dt.datetime(2024, 2, 1))]
    e = spark.createDataFrame(rows, "extract_id long, document_id long, content_length int, extracted_at timestamp")
    assert sorted(r.extract_id for r in text.corpus(e, since="2024-01-15").collect()) == [1, 2]


def test_cloud_size(spark):
    t = spark.createDataFrame([(0, "w", 0.0357)], "topic int, term string, weight double")
    assert topic_reports.cloud_sizes(t).first().size == 17


def test_keyed_update(spark):
    base = spark.createDataFrame([(1, 3), (2, 4)], "document_id long, main_topic int")
    upd = spark.createDataFrame([(2, 9), (7, 1)], "document_id long, main_topic int")
    got = sorted(tuple(r) for r in keyed_update(base, upd, ["document_id"], ["main_topic"]).collect())
    assert got == [(1, 3), (2, 9)]


def test_entity_search_is_case_insensitive_substring(spark):
    rep = spark.createDataFrame([(1, "Microsoft,Bob"), (2, "Alice"), (3, None)], "document_id long, ner string")
    got = sorted((r.keyword, r.document_id) for r in dashboard.entity_search(rep, ["micro", "ALI"]).collect())
    assert got == [("ali", 2), ("micro", 1)]


def test_phrases_of_any_length_the_longest_wins(spark):
    line = "one two three four five six seven two three x two  three".split(" ")
    rows = [(1, 0, p, w, "O") for p, w in enumerate(line) if w] + [(1, 1, p, w, "O") for p, w in enumerate(line[:5])]
    tokens = spark.createDataFrame(rows, "doc_id long, sent int, pos int, token string, tag string").repartition(3)
    book = spark.createDataFrame([("two three", "ORG"), ("two three four five six", "PERSON"), ("two three four five six", "GPE"),
                                  ("five six seven two three x", "ORG"), ("x", "ORG"), ("one two three four five seven", "ORG"),
                                  ("three four five", "PRODUCT"), ("four five", "ORG")], "phrase string, label string")
    got = sorted((r.sent, r.start, r.n, r.text, r.label) for r in entities.gazetteer_mentions(tokens, book).collect())
    assert got == [(0, 1, 5, "two three four five six", "GPE"), (0, 1, 5, "two three four five six", "PERSON"),
                   (0, 4, 6, "five six seven two three x", "ORG"),
                   (1, 1, 2, "two three", "ORG"), (1, 2, 3, "three four five", "PRODUCT")]
