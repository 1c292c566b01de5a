"""Registered queries for groups A, B, D, E, F1-F4 (pages in)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import dom, extract, keys, paths
from ..sources import tables as tb
from . import oracle_views as ov
from ..session import ensure_checkpoint_dir
from ..sources.snapshots import KeyedTable
from .content import stored_run
from .queries_topics import best_topic_sql, best_topics_of
from .registry import query


@query("f1_main_extract", ov.main_extract_sql())
def f1_main_extract(spark, sf):
    """Flagship: pages in, one main-content row per page out (E11 + F1-F3)."""
    return stored_run(tb.pages(spark, sf)).main


@query("f1_page_outcomes", f"""WITH x AS ({ov.main_extract_sql()}), {ov.PAGES}
SELECT pg.page_id, pg.domain, x.page_id IS NOT NULL AS extracted FROM pg LEFT JOIN x USING (page_id)""")
def f1_page_outcomes(spark, sf):
    """One row for every page: extracted, or why not."""
    p = tb.pages(spark, sf)
    run = stored_run(p)
    return extract.page_outcomes(p, run.main, run.model, run.nodes).select("page_id", "domain", "extracted")


@query("e2_path_ratio", f"""WITH {ov.PAGES}, {ov.TRAIN}, {ov.NODES}, {ov.ratios_sql()}
SELECT domain, path, CAST(seq AS INTEGER) AS seq, CAST(n_items AS BIGINT) AS n_items,
       round(ratio, 8) AS ratio FROM rat""")
def e2_path_ratio(spark, sf):
    run = stored_run(tb.pages(spark, sf))
    return run.ratios.select("domain", "path", "seq", F.col("n_items").cast("long"),
                             F.round("ratio", 8).alias("ratio"))


@query("e1_path_ratio_plain", f"""WITH {ov.PAGES}, {ov.TRAIN}, {ov.NODES}, {ov.ratios_sql()}
SELECT domain, path, CAST(seq AS INTEGER) AS seq, round(ratio * n_items, 6) AS ratio FROM rat""")
def e1_path_ratio_plain(spark, sf):
    run = stored_run(tb.pages(spark, sf))
    return paths.path_ratios(run.items, normalized=False, distances=run.distances).select("domain", "path", "seq",
                                                                 F.round("ratio", 6).alias("ratio"))


@query("e7_content_paths", f"""WITH {ov.PAGES}, {ov.TRAIN}, {ov.NODES}, {ov.ratios_sql()}, {ov.MODEL}
SELECT domain, CAST(seq AS INTEGER) AS seq, path, is_content FROM model""")
def e7_content_paths(spark, sf):
    run = stored_run(tb.pages(spark, sf))
    return run.model.select("domain", "seq", "path", "is_content")


# ---------------------------------------------------------------- B: keys

@query("b1_netloc", f"WITH {ov.PAGES} SELECT page_id, domain AS netloc FROM pg")
def b1_netloc(spark, sf):
    return keys.netloc(tb.pages(spark, sf)).select("page_id", "netloc")


@query("b2_root_key", f"""WITH {ov.PAGES}
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)) || '://' || domain || '/' AS root
FROM pg""")
def b2_root_key(spark, sf):
    return keys.root_key(tb.pages(spark, sf)).select("page_id", "root")


@query("b3_domain_keys", f"""WITH {ov.PAGES}
SELECT CAST(row_number() OVER (ORDER BY domain) AS BIGINT) AS domain_id, domain AS domain_name
FROM (SELECT DISTINCT domain FROM pg)""")
def b3_domain_keys(spark, sf):
    names = tb.pages(spark, sf).select(F.col("domain").alias("domain_name"))
    existing = spark.createDataFrame([], "domain_id long, domain_name string")
    return keys.get_or_create_keys(names, existing, "domain_name", "domain_id")


FIRST_SQL = f"""{ov.PAGES},
done AS (SELECT * FROM pg QUALIFY row_number() OVER (PARTITION BY domain ORDER BY page_id) = 1)"""


def _first_cycle(p):
    """Pages stored after a first poll cycle: the first page of each domain."""
    return keys.first_of_batch(p)


@query("b4_document_keys", f"""WITH {FIRST_SQL}
SELECT CAST((SELECT count(*) FROM done) + row_number() OVER (ORDER BY url) AS BIGINT) AS document_id, url
FROM pg WHERE page_id NOT IN (SELECT page_id FROM done)""")
def b4_document_keys(spark, sf):
    """Documents already stored get ids by URL; new keys for the rest."""
    p = tb.pages(spark, sf)
    stored = _first_cycle(p).select("url")
    existing = keys.dense_ids(stored, "url", "document_id")
    return keys.new_keys_only(p.select("url"), existing, "url", "document_id").select("document_id", "url")


@query("b5_unprocessed", f"""WITH {FIRST_SQL}
SELECT page_id, url FROM pg WHERE url NOT IN (SELECT url FROM done)""")
def b5_unprocessed(spark, sf):
    p = tb.pages(spark, sf)
    done = _first_cycle(p)
    return keys.unprocessed(p, done).select("page_id", "url")


B7_SQL = f"""{ov.PAGES},
b7 AS (SELECT d.domain, CAST(coalesce(c.n, 0) AS BIGINT) AS n_docs
       FROM (SELECT DISTINCT domain FROM pg) d
       LEFT JOIN (SELECT domain, count(*) AS n FROM pg GROUP BY 1) c USING (domain))"""


def _b7(spark, sf):
    p = tb.pages(spark, sf)
    return keys.per_domain_counts(p, p)


@query("b7_docs_per_domain", f"WITH {B7_SQL} SELECT domain, n_docs FROM b7")
def b7_docs_per_domain(spark, sf):
    return _b7(spark, sf)


@query("b8_training_gate", f"WITH {B7_SQL} SELECT domain, n_docs, n_docs = 0 OR n_docs < 50 AS train FROM b7")
def b8_training_gate(spark, sf):
    c = _b7(spark, sf)
    return keys.training_gate(c, models=c.filter("n_docs > 0"))


@query("b9_training_page", f"""WITH {ov.PAGES}
SELECT domain, page_id, url FROM pg QUALIFY row_number() OVER (PARTITION BY domain ORDER BY page_id) = 1""")
def b9_training_page(spark, sf):
    return keys.first_of_batch(tb.pages(spark, sf)).select("domain", "page_id", "url")


# ---------------------------------------------------------------- D: DOM

def _nodes(spark, sf, modes=("direct",)):
    return dom.explode_nodes(tb.pages(spark, sf).select("page_id", "domain", "html"), modes=modes)


@query("d1_doctype", f"""WITH {ov.PAGES}, d AS (
  SELECT page_id, domain, trim(regexp_extract(html, '(?i)<!doctype\\s+([^>]*)>', 1)) AS doctype FROM pg)
SELECT page_id, domain, doctype, CASE WHEN doctype = 'html' THEN 'html5' ELSE 'html4' END AS tag_set,
       CASE WHEN doctype = 'html' THEN 8 ELSE 2 END AS n_tags FROM d WHERE doctype <> ''""")
def d1_doctype(spark, sf):
    return dom.doctype_check(tb.pages(spark, sf))


@query("d2_page_paths", f"WITH {ov.PAGES}, {ov.NODES} SELECT domain, page_id, path AS abs_path FROM node")
def d2_page_paths(spark, sf):
    return dom.page_paths(_nodes(spark, sf))


@query("d5_direct_text", f"WITH {ov.PAGES}, {ov.NODES} SELECT page_id, path AS abs_path, item AS direct_text FROM node")
def d5_direct_text(spark, sf):
    return _nodes(spark, sf).select("page_id", "abs_path", "direct_text")


AD_INNER = "regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)"
FOOT_INNER = "regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)"
BODY_INNER = "regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)$', 1), '(?s)<!--.*?-->', '', 'g')"
COMMENT = "regexp_extract(html, '(?s)<!--(.*?)-->', 1)"
# of the article's h1 and p children those that begin with text of their own
ART_OWN = (f"array_to_string(list_filter(string_split_regex({ov.ART_INNER}, '<(h1|p)( [^>]*)?>'), "
           "lambda s: s <> '' AND s[1] <> '<'), ' ')")


def _text_sql(name: str, body: str, nav: str, ad: str, article: str, footer: str) -> str:
    paths = {"": body, "/nav": nav, "/div": ad, "/article": article, "/footer": footer}
    return f"WITH {ov.PAGES}\n" + "\nUNION ALL ".join(
        f"SELECT page_id, '/html/body{p}' AS abs_path, {ov.clean(x)} AS {name} FROM pg" for p, x in paths.items())


@query("d6_child_text", _text_sql("child_text", f"{COMMENT} || ' ' || {AD_INNER} || ' ' || {FOOT_INNER}", "''", "''", ART_OWN, "''"))
def d6_child_text(spark, sf):
    return _nodes(spark, sf, ("child",)).select("page_id", "abs_path", "child_text")


@query("d7_subtree_text", _text_sql("subtree_text", BODY_INNER, ov.NAV_INNER, AD_INNER, ov.ART_INNER, FOOT_INNER))
def d7_subtree_text(spark, sf):
    return _nodes(spark, sf, ("subtree",)).select("page_id", "abs_path", "subtree_text")


@query("d10_title", f"""WITH {ov.PAGES}
SELECT page_id, {ov.unescape("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS title FROM pg""")
def d10_title(spark, sf):
    pages = tb.pages(spark, sf).select("page_id", "domain", "html")
    return dom.page_titles(dom.explode_nodes(pages, modes=(), marks=True))


SUMMARY_SQL = f"""{ov.PAGES},
summ AS (
  SELECT DISTINCT domain, 'body/' || t.tag AS dict_path, t.cls AS class, '' AS id FROM pg,
    (VALUES ('nav', ''), ('div', 'ad'), ('article', ''), ('footer', '')) AS t(tag, cls)
  WHERE regexp_matches(html, '(?i)<!doctype\\s+html\\s*>'))"""


@query("d12_dom_summary", f"WITH {SUMMARY_SQL} SELECT domain, dict_path, class, id FROM summ")
def d12_dom_summary(spark, sf):
    s = dom.dom_summary(_nodes(spark, sf, ()))
    return s.select("domain", "dict_path", F.explode("values").alias("v")).select(
        "domain", "dict_path", F.col("v.class").alias("class"), F.col("v.id").alias("id"))


@query("d14_short_attribute_paths")
def d14_short_attribute_paths(spark, sf):
    return dom.short_attribute_paths(dom.dom_summary(_nodes(spark, sf, ())))


D15_SQL = f"""{SUMMARY_SQL},
d15 AS (
  SELECT DISTINCT domain, 'class_id' AS variant, '//*/' || dict_path ||
         CASE WHEN class <> '' THEN '[contains(@class, ''' || class || ''')]' ELSE '' END ||
         CASE WHEN id <> '' THEN '[contains(@id, ''' || id || ''')]' ELSE '' END AS xpath FROM summ
  UNION SELECT domain, 'id', '//*/' || dict_path ||
         CASE WHEN id <> '' THEN '[contains(@id, ''' || id || ''')]' ELSE '' END FROM summ
  UNION SELECT domain, 'none', '//*/' || dict_path FROM summ)"""


@query("d15_full_attribute_paths", f"WITH {D15_SQL} SELECT domain, variant, xpath FROM d15")
def d15_full_attribute_paths(spark, sf):
    return dom.full_attribute_paths(dom.dom_summary(_nodes(spark, sf, ())))


@query("d16_select_by_attribute_path", f"""WITH {D15_SQL}, {ov.NODES}
SELECT n.page_id, d15.xpath, n.path AS abs_path FROM d15 JOIN node n ON n.domain = d15.domain
  AND n.path = '/html/' || regexp_extract(d15.xpath, '^//\\*/([^\\[]*)', 1)
  AND (n.path <> '/html/body/div' OR d15.xpath NOT LIKE '%@class%' OR d15.xpath LIKE '%''ad''%')
WHERE d15.variant = 'class_id'""")
def d16_select_by_attribute_path(spark, sf):
    nodes = _nodes(spark, sf, ())
    xp = dom.full_attribute_paths(dom.dom_summary(nodes)).filter("variant = 'class_id'")
    return dom.select_by_attribute_path(nodes, xp).select("page_id", "xpath", "abs_path")


# ---------------------------------------------------------------- E: model tables

def _run(spark, sf):
    return stored_run(tb.pages(spark, sf))


RAT = f"{ov.PAGES}, {ov.TRAIN}, {ov.NODES}, {ov.ratios_sql()}"


@query("e5_ratio_history", f"""WITH {RAT}
SELECT domain, path, round(max_by(ratio, seq), 8) AS latest_ratio, CAST(count(*) AS BIGINT) AS n_rounds
FROM rat GROUP BY domain, path""")
def e5_ratio_history(spark, sf):
    h = paths.ratio_history(_run(spark, sf).ratios)
    return h.select("domain", "path", F.round("latest_ratio", 8).alias("latest_ratio"),
                    F.size("ratio_values").cast("long").alias("n_rounds"))


@query("e6_two_means_split", f"""WITH {RAT}, {ov.MODEL}
SELECT domain, CAST(seq AS INTEGER) AS seq, round(threshold, 8) AS threshold FROM sp WHERE rn = 1""")
def e6_two_means_split(spark, sf):
    s = paths.two_means_split(_run(spark, sf).ratios, ["domain", "seq"])
    return s.select("domain", "seq", F.round("threshold", 8).alias("threshold"))


@query("e9_extract_counts", f"""WITH {RAT}, {ov.MODEL}
SELECT domain, path, CAST(sum(CAST(is_content AS INTEGER)) AS BIGINT) AS extract_count FROM model GROUP BY ALL""")
def e9_extract_counts(spark, sf):
    return paths.extract_counts(_run(spark, sf).model)


@query("e10_content_path_list", f"""WITH {RAT}, {ov.MODEL}
SELECT domain, path FROM model WHERE is_content AND seq = (SELECT max(seq) FROM model m2 WHERE m2.domain = model.domain)""")
def e10_content_path_list(spark, sf):
    return paths.latest_content_paths(_run(spark, sf).model)


# ---------------------------------------------------------------- F4 / A sinks

@query("f4_extract_records", f"""WITH x AS ({ov.main_extract_sql()}), {ov.PAGES}
SELECT x.page_id AS document_id, x.domain, x.xpath, x.content, 'Attribs' AS xpath_type, x.content_length,
       {ov.unescape("regexp_extract(pg.html, '(?is)<title>(.*?)</title>', 1)")} AS title
FROM x JOIN pg USING (page_id)""")
def f4_extract_records(spark, sf):
    from ..operators.extract import extract_records
    run = _run(spark, sf)
    rec = extract_records(run.main, titles=dom.page_titles(run.nodes))
    return rec.select("document_id", "domain", "xpath", "content", "xpath_type", "content_length", "title")


FULL_SQL = f"""WITH x AS ({ov.main_extract_sql()}), {ov.PAGES}, {ov.TOPIC_TERMS}, {best_topic_sql('x', 'page_id', 'content')},
w0 AS (SELECT page_id, string_split(content, ' ') AS ws FROM x),
w1 AS (SELECT page_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS token FROM w0),
w2 AS (
  SELECT page_id, pos, trim(trim(token, '"'), chr(39)) AS tok, pos - row_number() OVER (PARTITION BY page_id ORDER BY pos) AS grp
  FROM w1 WHERE regexp_full_match(token, '[A-Z][a-z]+')),
w3 AS (SELECT page_id, grp, string_agg(tok, ' ' ORDER BY pos) AS phrase FROM w2 GROUP BY page_id, grp),
ner AS (SELECT page_id, array_to_string(list_sort(list_distinct(list(phrase))), ',') AS ner FROM w3 GROUP BY page_id)
SELECT x.page_id AS document_id, x.domain, x.xpath, x.content, 'Attribs' AS xpath_type, x.content_length,
       CAST(coalesce(bt.topic, 0) AS INTEGER) AS main_topic,
       {ov.unescape("regexp_extract(pg.html, '(?is)<title>(.*?)</title>', 1)")} AS title, ner.ner
FROM x JOIN pg USING (page_id) LEFT JOIN bt ON bt.id = x.page_id LEFT JOIN ner ON ner.page_id = x.page_id"""


@query("f4_full_records", FULL_SQL)
def f4_full_records(spark, sf):
    """F4 with topic and entities of each extract, appended to the extract table."""
    from ..operators import entities
    from ..operators.extract import extract_records
    from ..sources.store import append_extracts
    run = _run(spark, sf)
    topics = best_topics_of(spark, sf, run.main, "page_id", "content")
    words = run.main.select(F.col("page_id").alias("doc_id"), F.lit(0).alias("sent"),
                            F.posexplode(F.split("content", " ")).alias("pos", "token"))
    tagged = words.withColumn("tag", F.when(F.col("token").rlike("^[A-Z][a-z]+$"), "PERSON").otherwise("O"))
    ner = entities.entities_from_tokens(tagged).withColumnRenamed("doc_id", "page_id")
    records = extract_records(run.main, dom.page_titles(run.nodes), topics, ner)
    path = f"{ensure_checkpoint_dir(spark)}/extract-records/{uuid.uuid4().hex}"
    append_extracts(records, path)
    return spark.read.schema(records.schema).parquet(path).select(*records.columns)


@query("a1_rejected_pages", f"""WITH {ov.PAGES}
SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT page_id FROM pg)""")
def a1_rejected_pages(spark, sf):
    return tb.rejected_pages(spark, sf)


@query("a4_versioned_update", f"""WITH {ov.EXTRACTS},
upd AS (SELECT doc_id AS document_id, min(CAST(quality * 10 + toxic AS INTEGER)) AS main_topic FROM labels GROUP BY 1)
SELECT e.extract_id, e.document_id, coalesce(upd.main_topic, e.main_topic) AS main_topic
FROM extracts e LEFT JOIN upd USING (document_id)""")
def a4_versioned_update(spark, sf):
    """A4 on a stored table: only the buckets of updated documents are written."""
    table = KeyedTable(spark, f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}",
                       "extract_id long, document_id long, main_topic int", "document_id")
    table.create(tb.extracts(spark, sf))
    table.update(tb.table(spark, sf, "labels").select(
        F.col("doc_id").alias("document_id"), (F.col("quality") * 10 + F.col("toxic")).cast("int").alias("main_topic")), ["main_topic"])
    return table.read()


@query("a4_keyed_update", f"""WITH {ov.EXTRACTS},
rep AS (SELECT * FROM extracts QUALIFY row_number() OVER (
  PARTITION BY document_id ORDER BY content_length DESC NULLS LAST, extract_id) = 1),
upd AS (SELECT doc_id AS document_id, CAST(quality * 10 + toxic AS INTEGER) AS main_topic FROM labels)
SELECT rep.document_id, coalesce(upd.main_topic, rep.main_topic) AS main_topic
FROM rep LEFT JOIN upd USING (document_id)""")
def a4_keyed_update(spark, sf):
    from ..operators.dashboard import representative
    from ..sources.store import keyed_update
    rep = representative(tb.extracts(spark, sf)).select("document_id", "main_topic")
    upd = tb.table(spark, sf, "labels").select(
        F.col("doc_id").alias("document_id"), (F.col("quality") * 10 + F.col("toxic")).cast("int").alias("main_topic"))
    return keyed_update(rep, upd, ["document_id"], ["main_topic"])


@query("a9_ratio_log", f"""WITH {RAT}
SELECT domain, path || ';--;' || printf('%.8f', ratio) AS line FROM rat""")
def a9_ratio_log(spark, sf):
    from ..sources.store import ratio_log_lines
    return ratio_log_lines(_run(spark, sf).ratios)
