import pytest
from pyspark.sql import functions as F

from pathsift.operators import dom, extract, topics
from pathsift.streaming import feeds, ingest

pytestmark = pytest.mark.usefixtures("few_partitions")


def _pages(n, start=0):
    return [(i, f"http://site{i % 2}.org/{i}",
             f"<!DOCTYPE html><html><head><title>t{i}</title></head><body><nav>Home About</nav>"
             f"<article>{'word%d ' % i * (i % 5 + 9)}</article></body></html>") for i in range(start, start + n)]


def _content(store):
    return {r.page_id: (r.xpath, r.content) for r in store.table("extracts").collect()}


def _one_cycle(spark, path, rows):
    store = ingest.open_store(spark, str(path))
    attempt = store.begin(0)
    ingest.ingest_cycle(spark.createDataFrame(rows, ingest.ARTICLES), store, attempt)
    attempt.commit()
    return store


def test_cycles_equal_one_batch_and_rerun_adds_nothing(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "store")
    rows = _pages(8) + [(90, None, "<html></html>"), (91, "http://site0.org/0", "again")]
    spark.createDataFrame(rows, ingest.ARTICLES).coalesce(1).write.parquet(src)
    for _ in range(2):
        ingest.run_article_stream(spark, src, out, str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame(_pages(4, 6), ingest.ARTICLES).coalesce(1).write.mode("append").parquet(src)
    ingest.run_article_stream(spark, src, out, str(tmp_path / "ck")).awaitTermination()

    store = ingest.open_store(spark, out)
    assert sorted(r.page_id for r in store.table("documents").collect()) == list(range(10))
    assert [r.page_id for r in store.table("quarantine").collect()] == [90]
    got = _content(store)
    rejected = {r.page_id for r in store.table("rejects").collect()}
    assert set(got) | rejected == set(range(10)) and not set(got) & rejected
    assert _content(_one_cycle(spark, tmp_path / "whole", _pages(10))) == got


def test_three_training_cycles_equal_one_and_parse_once(spark, tmp_path):
    """Models, ratios and distances grow by cycle; nothing stored is made again."""
    store = ingest.open_store(spark, str(tmp_path / "a"))
    for cycle, (n, start) in enumerate([(6, 0), (5, 6), (4, 11)]):
        attempt = store.begin(cycle)
        ingest.ingest_cycle(spark.createDataFrame(_pages(n, start), ingest.ARTICLES), store, attempt, limit=6)
        attempt.commit()
        assert store.begin(cycle) is None
    whole = ingest.open_store(spark, str(tmp_path / "b"))
    attempt = whole.begin(0)
    ingest.ingest_cycle(spark.createDataFrame(_pages(15), ingest.ARTICLES), whole, attempt, limit=6)
    attempt.commit()

    def rows(st, name, *cols):
        return sorted(map(str, st.table(name).select(*[F.round(c, 12) if c == "ratio" else c for c in cols]).collect()))

    for name, cols in {"ratios": ["domain", "path", "seq", "n_items", "ratio"], "train_pages": ["domain", "page_id", "seq"],
                       "model": ["domain", "seq", "path", "is_content"], "extracts": ["page_id", "content"],
                       "distances": ["x", "y", "lev"]}.items():
        assert rows(store, name, *cols) == rows(whole, name, *cols), name
    parsed = store.table("nodes").filter("node_seq = -1")
    assert parsed.count() == 15 == parsed.select("page_id").distinct().count()


def test_changed_feeds_bring_documents_and_a_killed_cycle_does_not(spark, tmp_path):
    pages = spark.createDataFrame(_pages(12) + [(12, None, "x")], ingest.ARTICLES)
    rows = [(f, f"2024-03-01 0{h}:10:00", 10 * f + h, True, etag, None)
            for f, etags in enumerate(["aab", "ccc", "dd"]) for h, etag in enumerate(etags)]
    polls = spark.createDataFrame(rows, "feed_url long, t string, event_id long, ok boolean, etag string, modified string") \
        .withColumn("poll_ts", F.to_timestamp("t")).select(*feeds.POLL_COLUMNS)
    killed = []

    def entries(changed):
        if not killed:
            killed.append(changed.count())
            raise RuntimeError("killed")
        listed = changed.select(F.explode(F.expr("sequence(feed_url * 4, feed_url * 4 + 4)")).alias("page_id"))
        return listed.join(pages, "page_id")

    def run():
        ingest.run_ingest_stream(spark, str(tmp_path / "in"), entries, str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination()

    polls.filter("poll_ts < '2024-03-01 02:00:00'").coalesce(1).write.parquet(str(tmp_path / "in"))
    feeds.end_mark(spark, str(tmp_path / "in"), "2024-02-29 03:00:00")
    store = ingest.open_store(spark, str(tmp_path / "store"))
    try:
        run()
    except Exception as e:
        assert "killed" in str(e)
    assert store.manifests() == []
    run()
    first = {r.page_id for r in store.table("documents").collect()}
    polls.filter("poll_ts >= '2024-03-01 02:00:00'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feeds.end_mark(spark, str(tmp_path / "in"), "2024-03-02 00:00:00")
    run()
    assert first == set(range(12)) == {r.page_id for r in store.table("documents").collect()}
    assert [r.page_id for r in store.table("quarantine").collect()] == [12]
    assert store.table("changes").count() == 8 and store.table("changes").filter("changed").count() == 4
    assert _content(_one_cycle(spark, tmp_path / "whole", _pages(12))) == _content(store)


def test_links_into_fetched_pages_give_the_rows_of_whole_articles(spark, tmp_path):
    """markup is read for new documents, not carried by every entry."""
    pages = spark.createDataFrame(_pages(6) + [(3, "http://site1.org/other", "<p>other</p>")], ingest.ARTICLES)
    rows = _pages(5) * 3 + [(5, None, "x"), (5, None, "x")]
    links = spark.createDataFrame(rows, ingest.ARTICLES)
    stores = []
    for name, args in (("whole", (links, None)), ("links", (links.drop("html"), pages))):
        store = ingest.open_store(spark, str(tmp_path / name))
        attempt = store.begin(0)
        ingest.ingest_cycle(args[0], store, attempt, fetched=args[1])
        attempt.commit()
        stores.append({t: sorted(map(str, store.table(t).drop("bucket").collect())) for t in ("documents", "quarantine", "rejects", "extracts")})
    assert stores[0] == stores[1] and len(stores[0]["documents"]) == 5 and len(stores[0]["quarantine"]) == 2


def test_page_outcomes_name_every_page(spark):
    pages = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "page_id long, domain string")
    main = spark.createDataFrame([(1, "a")], "page_id long, domain string")
    model = spark.createDataFrame([("a", 1)], "domain string, seq int")
    got = {r.page_id: r.reason for r in extract.page_outcomes(pages, main, model).collect()}
    assert got == {1: None, 2: "no_text", 3: "no_model"}


def test_short_attribute_paths_need_a_descendant(spark):
    rows = [("d", p, [(c, "")]) for p, c in
            [("body/div", "a"), ("body/div/nav", "b"), ("body/divider", "c"), ("body/div/nav/p", "")]]
    s = spark.createDataFrame(rows, "domain string, dict_path string, values array<struct<class:string,id:string>>")
    got = {r.xpath for r in dom.short_attribute_paths(s).collect()}
    assert got == {"//*/div[contains(@class, 'a')]", "//*/nav[contains(@class, 'b')]"}


def test_reloaded_topic_model_scores_identically(spark, tmp_path):
    docs = spark.range(12).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 2 == 0, "engine wheel brake engine motor").otherwise("flour sugar butter oven flour").alias("t"))
    tokens = topics.token_frame(docs, "doc_id", "t")
    model = topics.fit_lda(tokens, k=2, passes=5)
    topics.save_model(model, str(tmp_path))
    again = topics.load_model(str(tmp_path), model.name)
    a = sorted(map(tuple, topics.main_topics(model, tokens).collect()))
    assert a == sorted(map(tuple, topics.main_topics(again, tokens).collect()))
    weights = topics.topic_term_weights(topics.stored_lambda(spark, str(tmp_path), model.name),
                                        topics.stored_vocabulary(spark, str(tmp_path), model.name))
    sums = weights.groupBy("topic").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)
