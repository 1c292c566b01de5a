"""Sinks, merged DOM summaries, warm start and the topic model's update step."""

import json

import pytest
from pyspark.sql import functions as F

from pathsift.operators import dom, paths, topics
from pathsift.sources import store


def test_append_is_partitioned_and_keeps_earlier_rows(spark, tmp_path):
    path = str(tmp_path / "extracts")
    for rows in ([(1, "a", "x")], [(2, "b", "y"), (3, "a", "z")]):
        store.append_extracts(spark.createDataFrame(rows, "document_id int, domain string, content string"), path)
    got = store.load_table(spark, path)
    assert sorted(r.document_id for r in got.collect()) == [1, 2, 3]
    assert sorted(r.document_id for r in got.filter("domain = 'a'").collect()) == [1, 3]


def test_sql_takes_named_parameters(spark):
    df = spark.createDataFrame([(1, "it's"), (2, "b")], "id int, name string")
    got = store.sql(spark, "SELECT id FROM stored WHERE name = :name", {"stored": df}, {"name": "it's"}).collect()
    assert [r.id for r in got] == [1]


def test_path_model_is_stored_and_emptied(spark, tmp_path):
    path = str(tmp_path / "model")
    model = spark.createDataFrame([("a", 1, "/html/body", True)], "domain string, seq int, path string, is_content boolean")
    store.save_table(model, path)
    assert store.load_table(spark, path).collect() == model.collect()
    store.truncate(model, path)
    assert store.load_table(spark, path).schema == model.schema and not store.load_table(spark, path).collect()


def test_reports_as_lines_and_json(spark, tmp_path):
    o = spark.createDataFrame([("k", 3, "t1, t2")], "key string, topic int, terms string")
    store.write_report(o, str(tmp_path / "csv"))
    store.write_report(o, str(tmp_path / "json"), fmt="json")
    assert [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()] == ["k;3;t1, t2"]
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()] == [
        {"key": "k", "topic": 3, "terms": "t1, t2"}]


def test_ratio_log_appends(spark, tmp_path):
    r = spark.createDataFrame([("d", "/html", 0.5)], "domain string, path string, ratio double")
    for _ in range(2):
        store.append_ratio_log(r, str(tmp_path / "log"))
    assert [x.value for x in spark.read.text(str(tmp_path / "log")).collect()] == ["/html;--;0.50000000"] * 2


def test_summaries_merge_by_union_or_last_page(spark):
    page = "<!DOCTYPE html><html><body><nav class='{}'>x</nav></body></html>"
    pages = spark.createDataFrame([(1, "d", page.format("old")), (2, "d", page.format("new"))],
                                  "page_id long, domain string, html string")
    nodes = dom.explode_nodes(pages, modes=())
    values = lambda mode: [sorted(v["class"] for v in r["values"])
                           for r in dom.dom_summary(nodes, mode=mode).filter("dict_path = 'body/nav'").collect()]
    assert values("union") == [["new", "old"]] and values("last") == [["new"]]
    doc = json.loads(store.summary_json(dom.dom_summary(nodes, mode="last").filter("dict_path = 'body/nav'")).first().json)
    assert doc == {"dict_path": "body/nav", "values": [{"class": "new", "id": ""}]}


def test_warm_start_moves_the_stored_centres(spark):
    r = spark.createDataFrame([("d", "a", 0.1), ("d", "b", 0.2), ("d", "c", 0.9)], "domain string, path string, ratio double")
    c = spark.createDataFrame([("d", 0.0, 1.0)], "domain string, lo_center double, hi_center double")
    got = {x.path: (x.is_content, round(x.lo_center, 9), x.hi_center) for x in paths.warm_start_step(r, c).collect()}
    assert got == {"a": (False, 0.15, 0.9), "b": (False, 0.15, 0.9), "c": (True, 0.15, 0.9)}


def test_texts_of_one_path_compare_by_content(spark):
    """One item a round: round 1 against 'empty' alone, round 2 also against round 1."""
    rows = [("d", 1, "p", "abcd"), ("d", 2, "p", "abce")]
    items = spark.createDataFrame(rows, "domain string, seq int, path string, item string")
    got = {r.seq: r.ratio for r in paths.path_ratios(items).collect()}
    to_empty = 2 * 5 / 9            # four letters against 'empty', none in place: five edits
    assert got[1] == pytest.approx(to_empty)
    assert got[2] == pytest.approx((to_empty + 2 * 1 / 8) / 2)


def test_stored_topic_parameters_equal_the_model(spark, tmp_path):
    docs = spark.createDataFrame([(k, "engine wheel brake motor" if k % 2 else "flour sugar oven") for k in range(8)],
                                 "doc_id long, t string")
    model = topics.fit_lda(topics.token_frame(docs, "doc_id", "t"), k=3, passes=4)
    topics.save_model(model, str(tmp_path))
    want = model.lda.topicsMatrix().toArray()
    lam = topics.stored_lambda(spark, str(tmp_path), model.name)
    got = {(r.term_index, r.topic): r.lam for r in lam.collect()}
    assert got == {(i, j): want[i, j] for i in range(want.shape[0]) for j in range(want.shape[1])}
    vocabulary = topics.stored_vocabulary(spark, str(tmp_path), model.name)
    assert [r.term for r in vocabulary.orderBy("term_index").collect()] == model.vectorizer.vocabulary
    top = topics.topic_term_weights(lam, vocabulary, top_n=1).collect()
    assert {r.topic for r in top} == {0, 1, 2}
    assert all(r.weight == pytest.approx(want[:, r.topic].max() / want[:, r.topic].sum()) for r in top)


def test_online_step_with_one_topic_is_the_weighted_count(spark):
    """With one topic every token belongs to it, so the step is known in closed form."""
    lam = spark.createDataFrame([(0, 0, 2.0), (0, 1, 4.0)], "topic int, term_index int, lam double")
    bow = spark.createDataFrame([(1, 0, 3.0), (2, 0, 1.0)], "doc_id long, term_index int, n double")
    out = topics.online_update(lam, bow, 1, n_docs_total=10, rho=0.25)
    got = {r.term_index: r.lam for r in out.collect()}
    assert got[0] == pytest.approx(0.75 * 2 + 0.25 * (1 + 10 / 2 * 4))
    assert got[1] == pytest.approx(0.75 * 4 + 0.25 * 1)


def test_online_step_keeps_the_tokens_of_each_document(spark):
    lam = spark.createDataFrame([(t, w, 1.0 + (t == w)) for t in range(2) for w in range(3)],
                                "topic int, term_index int, lam double")
    bow = spark.createDataFrame([(1, 0, 3.0), (1, 2, 2.0), (2, 1, 5.0)], "doc_id long, term_index int, n double")
    out = topics.online_update(lam, bow, 2, n_docs_total=2, rho=1.0, eta=0.0).groupBy("term_index").agg(F.sum("lam"))
    assert {r[0]: round(r[1], 9) for r in out.collect()} == {0: 3.0, 1: 5.0, 2: 2.0}


def test_step_size_falls_with_the_updates():
    assert topics.step_size(0) == 1 and topics.step_size(99) == pytest.approx(0.1)
