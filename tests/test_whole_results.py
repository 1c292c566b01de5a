"""Results that must be whole: no dropped pairs, phrases or pages, unique ids."""

from pyspark.sql import functions as F

from pathsift.functions import html_tree
from pathsift.operators import entities, keys, topic_reports


def test_dense_ids_without_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        values = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("v"))
        out = keys.dense_ids(values, "v", "k").agg(F.countDistinct("k"), F.min("k"), F.max("k")).first()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert tuple(out) == (200_000, 1, 200_000)


def test_topic_distances_list_disjoint_topics(spark):
    tt = spark.createDataFrame([(0, "a", 1.0), (1, "a", 0.5), (2, "b", 2.0)], "topic int, term string, weight double")
    got = {(r[0], r[1]): r[2] for r in topic_reports.topic_distances(tt).collect()}
    assert len(got) == 9 and got[0, 1] == got[1, 0] == 0.5
    assert abs(got[0, 2] - 5 ** 0.5) < 1e-12 and got[2, 2] == 0


def test_gazetteer_longest_phrase(spark):
    words = "the New York Times Best Seller list".split()
    t = spark.createDataFrame([(1, 0, k, w) for k, w in enumerate(words)], "doc_id bigint, sent int, pos int, token string")
    g = spark.createDataFrame([("New York Times Best Seller", "ORG"), ("New York", "GPE")], "phrase string, label string")
    got = entities.gazetteer_mentions(t, g).collect()
    assert [(r["text"], r["label"]) for r in got] == [("New York Times Best Seller", "ORG")]


def test_deep_page_keeps_its_text():
    n = 3000
    root = html_tree.Node("div")
    node = root
    for _ in range(n):
        child = html_tree.Node("b")
        child.text, child.tail = "x", "y"
        node.children.append(child)
        node = child
    assert html_tree._text(root) == "x" * n + "y" * n
