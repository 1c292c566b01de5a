"""Versioned keyed updates, growing vocabularies and topics over stored scores."""

import pytest
from pyspark.sql import functions as F

from pathsift.operators import text, topics
from pathsift.sources.cycles import CycleStore
from pathsift.sources.snapshots import KeyedTable

SCHEMA = "k long, v int, w string"


def test_update_writes_touched_buckets_only_and_keeps_versions(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), SCHEMA, "k", n_buckets=8)
    assert t.read().isEmpty()
    t.create(spark.createDataFrame([(k, None if k % 2 else k, "x") for k in range(100)] + [(None, None, "null")], SCHEMA))
    before = t.versions()[0]
    touched = t.update(spark.createDataFrame([(3, 33), (3, 34), (4, 44), (500, 1)], "k long, v int"), ["v"], only_missing=True)
    got = {r.k: r.v for r in t.read().collect()}
    assert got[3] == 33 and got[4] == 4 and 500 not in got and len(got) == 101
    after = t.versions()[1]
    assert {b for b in before if before[b] != after[b]} == set(touched) and len(touched) <= 3
    t.update(spark.createDataFrame([(4, 44), (5, None), (None, 7)], "k long, v int"), ["v"])
    got = {r.k: r.v for r in t.read().collect()}
    assert got[4] == 44 and got[5] is None and got[None] == 7
    assert {r.k: r.v for r in t.read(version=0).collect()}[4] == 4
    with pytest.raises(Exception, match="already exists"):
        t.create(t.read())                                # a version is published once


def test_term_ids_never_change(spark, tmp_path):
    store = CycleStore(spark, str(tmp_path), text.VOCABULARY_TABLES)
    for cycle, words in enumerate([["pear", "apple"], ["fig", "apple", "zebra"], ["pear"]]):
        counts = text.term_counts(spark.createDataFrame([(cycle, w) for w in words * 2], "document_id long, token string"))
        attempt = store.begin(cycle)
        text.vocabulary_cycle(store, attempt, counts)
        attempt.commit()
    ids = {r.term: r.term_id for r in store.table("terms").collect()}
    assert ids == {"apple": 0, "pear": 1, "fig": 2, "zebra": 3}
    assert sorted(map(tuple, store.table("bags").collect())) == [(0, 0, 2), (0, 1, 2), (1, 0, 2), (1, 2, 2), (1, 3, 2), (2, 1, 2)]


def test_a_vocabulary_cycle_makes_its_counts_once(spark, tmp_path):
    """terms and bags read stored counts; texts are not tokenized for each."""
    made = spark.sparkContext.accumulator(0)
    token = F.udf(lambda t: made.add(1) or t)
    tokens = spark.createDataFrame([(1, "fig"), (1, "pear"), (2, "fig")], "document_id long, token string")
    store = CycleStore(spark, str(tmp_path), text.VOCABULARY_TABLES)
    attempt = store.begin(0)
    text.vocabulary_cycle(store, attempt, text.term_counts(tokens.withColumn("token", token("token"))))
    attempt.commit()
    assert made.value == 3
    assert sorted(map(tuple, store.table("bags").collect())) == [(1, 0, 1), (1, 1, 1), (2, 0, 1)]


def test_best_topic_ties_and_empty(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 1)], "id long, token string, n long")
    terms = spark.createDataFrame([(0, "a", 0.25), (1, "b", 0.5), (2, "a", 0.25)], "topic int, term string, weight double")
    ids = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    got = {r.id: r.main_topic for r in topics.best_topics(ids, topics.topic_scores(counts, terms, "id"), "id").collect()}
    assert got == {1: 0, 2: 0}
