"""Substring index, ranks in huge groups, nested pages through the path joins, package on executors."""

import random

from pyspark.sql import functions as F

from pathsift.operators import dom, substring_index, topic_reports


def test_substring_search_equals_scan(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([None, "", "ab"]) if k % 7 == 0 else "".join(rnd.choice("abcABÉé,") for _ in range(rnd.randrange(30))))
            for k in range(300)]
    df = spark.createDataFrame(rows, "id long, ner string").withColumnRenamed("id", "document_id")
    substring_index.build_index(df, str(tmp_path / "i"), "document_id", "ner")
    words = ["aab", "'ABC'", "é,a", "b", "Éé", "zzz", "", "abcabc", "aaaa"]
    got = sorted((r.document_id, r.keyword) for r in substring_index.search(df, str(tmp_path / "i"), "document_id", "ner", words).collect())
    kws = sorted({w.strip('"').strip("'").lower() for w in words if w})
    assert got == sorted((k, w) for k, t in rows for w in kws if w in (t or "").lower())
    assert substring_index.search(df, str(tmp_path / "i"), "document_id", "ner", []).count() == 0


def test_ranks_in_a_huge_group(spark):
    rnd = random.Random(1)
    rows = [("hot", rnd.randrange(50) / 7, f"t{k}") for k in range(3000)] + [(f"g{k % 5}", 1.0, f"t{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "g string, w double, term string")
    got = {(r.g, r.term): r["rank"] for r in topic_reports.ranks_in_groups(df, "g", ["w", "term"]).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((w, t) for h, w, t in rows if h == g)
        assert [got[g, t] for _, t in mine] == list(range(1, len(mine) + 1))
    parts = topic_reports.ranks_in_groups(df, "g", ["w", "term"]).groupBy(F.spark_partition_id()).count().count()
    assert parts >= 1


NESTED = """<!DOCTYPE html><html><body><div class="a"><div class="b"><span id="x">one</span></div>
<div class="b c"><span>two</span><p>p</p></div></div><div><section><div><article><span>deep</span></article></div></section></div></body></html>"""


def _nodes(spark):
    pages = spark.createDataFrame([(1, "d", NESTED), (2, "d", "<p>no structure<title>t2</title></p>")], "page_id long, domain string, html string")
    return dom.explode_nodes(pages, modes=("direct",), marks=True)


def test_paths_without_index_hit_all_siblings(spark):
    nodes = _nodes(spark).filter("node_seq >= 0")
    paths = spark.createDataFrame([("d", p) for p in ["/html/body/div/div/span", "/html/body/div[1]/div[2]", "/html/body/div[2]/div",
                                                      "/html/body/div/section/div/article/span"]], "domain string, abs_path string")
    got = sorted((r.path, r.abs_path) for r in dom.select_by_path(nodes, paths).collect())
    assert got == [("/html/body/div/div/span", "/html/body/div[1]/div[1]/span"), ("/html/body/div/div/span", "/html/body/div[1]/div[2]/span"),
                   ("/html/body/div/section/div/article/span", "/html/body/div[2]/section/div/article/span"),
                   ("/html/body/div[1]/div[2]", "/html/body/div[1]/div[2]")]


def test_summary_and_attribute_paths_of_nested_pages(spark):
    nodes = _nodes(spark).filter("node_seq >= 0")
    summary = dom.dom_summary(nodes)
    got = {r.dict_path: [(v["class"], v["id"]) for v in r["values"]] for r in summary.collect()}
    assert got["body/div/div"] == [("b", ""), ("b c", "")] and got["body/div/div/span"] == [("", ""), ("", "x")]
    assert got["body/div/section/div/article/span"] == [("", "")]
    short = {r.xpath for r in dom.short_attribute_paths(summary).collect()}
    assert "//*/div[contains(@class, 'b c')]" in short and "//*/section" in short and not any("span" in x for x in short)
    asked = spark.createDataFrame([("d", x) for x in ["//*/div[contains(@class, 'b')]", "//*/div/div/span[contains(@id, 'x')]",
                                                      "//*/section/div/article/span"]], "domain string, xpath string")
    hit = sorted((r.xpath, r.abs_path) for r in dom.select_by_attribute_path(nodes, asked).collect())
    assert hit == [("//*/div/div/span[contains(@id, 'x')]", "/html/body/div[1]/div[1]/span"),
                   ("//*/div[contains(@class, 'b')]", "/html/body/div[1]/div[1]"), ("//*/div[contains(@class, 'b')]", "/html/body/div[1]/div[2]"),
                   ("//*/section/div/article/span", "/html/body/div[2]/section/div/article/span")]


def test_titles_of_pages_without_structure(spark):
    assert {r.page_id: r.title for r in dom.page_titles(_nodes(spark)).collect()} == {1: None, 2: "t2"}


def test_the_sentinels_word_is_a_text(spark):
    """A page whose text is the sentinel's word keeps its row; one without text does not."""
    from pathsift.operators import extract
    pages = spark.createDataFrame([(1, "d", "<html><body><div><p>empty</p></div></body></html>"),
                                   (2, "d", "<html><body><div></div></body></html>")], "page_id long, domain string, html string")
    nodes = dom.explode_nodes(pages, marks=True).filter("node_seq >= 0")
    items = nodes.select("page_id", "domain", F.col("abs_path").alias("path"), F.col("direct_text").alias("item"), "no_text")
    got = [(r.page_id, r.xpath, r.content) for r in extract.longest_extract(items).collect()]
    assert got == [(1, "/html/body/div", "empty")]
