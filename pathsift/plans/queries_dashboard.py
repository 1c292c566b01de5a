"""Registered queries for the dashboard group J (extract table in)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import dashboard as db
from ..operators import substring_index, text
from ..session import ensure_checkpoint_dir
from ..sources import tables as tb
from ..streaming import counts
from . import oracle_views as ov
from .registry import query

REP_SQL = f"""{ov.EXTRACTS},
rep AS (SELECT * FROM extracts QUALIFY row_number() OVER (
  PARTITION BY document_id ORDER BY content_length DESC NULLS LAST, extract_id) = 1)"""

KW = tb.ENTITY_KEYWORDS
KW_SQL = "[" + ", ".join(f"'{k.lower()}'" for k in KW) + "]"

HITS_SQL = f"""{REP_SQL},
hits0 AS (SELECT rep.*, kw AS keyword FROM rep, unnest({KW_SQL}) AS t(kw)
          WHERE contains(lower(coalesce(ner, '')), kw)),
hits AS (SELECT * FROM hits0 QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY document_id DESC) <= 50),
hitd AS (SELECT DISTINCT document_id, content, title, main_topic, extracted_at, ner FROM hits0)"""


def _rep(spark, sf):
    return db.representative(tb.extracts(spark, sf))


@query("j1_representative", f"WITH {REP_SQL} SELECT document_id, extract_id, content_length FROM rep")
def j1_representative(spark, sf):
    return _rep(spark, sf).select("document_id", "extract_id", "content_length")


@query("j2_docs_per_topic", f"""WITH {REP_SQL}
SELECT main_topic, CAST(count(*) AS BIGINT) AS n_docs FROM rep GROUP BY main_topic""")
def j2_docs_per_topic(spark, sf):
    return db.docs_per_topic(_rep(spark, sf))


TOPIC_DOCS_SQL = f"""{REP_SQL},
td AS (SELECT * FROM rep QUALIFY row_number() OVER (PARTITION BY main_topic ORDER BY document_id DESC) <= 50)"""


@query("j3_topic_documents", f"""WITH {TOPIC_DOCS_SQL}
SELECT main_topic, document_id, title, extracted_at FROM td""")
def j3_topic_documents(spark, sf):
    return db.topic_documents(_rep(spark, sf)).select("main_topic", "document_id", "title", "extracted_at")


@query("j3_topic_documents_all", f"""WITH {REP_SQL}
SELECT main_topic, document_id, title, extracted_at FROM rep""")
def j3_topic_documents_all(spark, sf):
    docs = db.topic_documents(_rep(spark, sf), limit=None)
    return db.ordered(docs, "extracted_at", descending=True).select("main_topic", "document_id", "title",
                                                                    "extracted_at")


@query("j4_docs_per_day", f"""WITH {TOPIC_DOCS_SQL}
SELECT main_topic, CAST(extracted_at AS DATE) AS day, CAST(count(*) AS BIGINT) AS n_docs FROM rep GROUP BY ALL""")
def j4_docs_per_day(spark, sf):
    return db.docs_per_day(db.topic_documents(_rep(spark, sf), limit=None))


@query("j5_entity_search", f"WITH {HITS_SQL} SELECT keyword, document_id, main_topic FROM hits")
def j5_entity_search(spark, sf):
    return db.entity_search(_rep(spark, sf), KW).select("keyword", "document_id", "main_topic")


@query("j5_entity_search_all", f"WITH {HITS_SQL} SELECT keyword, document_id, main_topic FROM hits0")
def j5_entity_search_all(spark, sf):
    return db.entity_search(_rep(spark, sf), KW, limit=None).select("keyword", "document_id", "main_topic")


@query("j5_entity_search_index", f"WITH {HITS_SQL} SELECT keyword, document_id, main_topic FROM hits0")
def j5_entity_search_index(spark, sf):
    """The same hits through trigram postings."""
    rep = _rep(spark, sf)
    path = f"{ensure_checkpoint_dir(spark)}/indexes/{uuid.uuid4().hex}"
    substring_index.build_index(rep, path, "document_id", "ner")
    return substring_index.search(rep, path, "document_id", "ner", KW).select("keyword", "document_id", "main_topic")


@query("j6_entity_hits", f"WITH {HITS_SQL} SELECT document_id, extracted_at FROM hitd")
def j6_entity_hits(spark, sf):
    return db.entity_hits(db.entity_search(_rep(spark, sf), KW, limit=None)).select("document_id", "extracted_at")


@query("j7_hits_per_topic", f"""WITH {HITS_SQL}
SELECT main_topic, CAST(count(*) AS BIGINT) AS n_docs FROM hitd GROUP BY main_topic""")
def j7_hits_per_topic(spark, sf):
    return db.hits_per_topic(db.entity_hits(db.entity_search(_rep(spark, sf), KW, limit=None)))


@query("j8_hit_topic_keywords", f"""WITH {HITS_SQL}, {ov.TOPIC_TERMS},
top AS (SELECT topic, term, weight, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank
        FROM topic_terms QUALIFY rank <= 20)
SELECT topic, term, round(weight, 8) AS weight, CAST(rank AS INTEGER) AS rank FROM top
WHERE topic IN (SELECT main_topic FROM hitd)""")
def j8_hit_topic_keywords(spark, sf):
    per = db.hits_per_topic(db.entity_hits(db.entity_search(_rep(spark, sf), KW, limit=None)))
    k = db.hit_topic_keywords(per, tb.topic_terms(spark, sf))
    return k.select("topic", "term", F.round("weight", 8).alias("weight"), "rank")


@query("j9_chart_rows", f"""WITH {REP_SQL}, c AS (SELECT main_topic, count(*) AS n FROM rep GROUP BY 1)
SELECT CAST(main_topic AS VARCHAR) AS label, CAST(n AS BIGINT) AS value,
       '{{"c":[{{"v":"' || main_topic || '"}},{{"v":' || n || '}}]}}' AS row_json FROM c""")
def j9_chart_rows(spark, sf):
    return db.chart_rows(db.docs_per_topic(_rep(spark, sf)), "main_topic", "n_docs")


@query("j10_article_list", f"""WITH {TOPIC_DOCS_SQL}
SELECT content, title, document_id AS article_id,
  list_transform(list_filter(string_split(ner, ','), lambda x: x <> ''), lambda x: trim(trim(x, '"'), '''')) AS ner_list,
  false AS show FROM td""")
def j10_article_list(spark, sf):
    return db.article_list(db.topic_documents(_rep(spark, sf)))


@query("j11_no_entity_count", f"""WITH {ov.EXTRACTS}
SELECT CAST(count(*) AS BIGINT) AS n FROM extracts WHERE ner IS NULL OR ner = '' OR ner = ''''""")
def j11_no_entity_count(spark, sf):
    return db.no_entity_count(tb.extracts(spark, sf))


@query("j12_with_entities", f"""WITH {ov.EXTRACTS}
SELECT extract_id, document_id, ner FROM extracts WHERE ner IS NOT NULL AND ner <> '''' AND ner <> ''""")
def j12_with_entities(spark, sf):
    return db.with_entities(tb.extracts(spark, sf))


@query("j13_newest_first", f"""WITH {REP_SQL}
SELECT document_id, main_topic, content, ner, title, extracted_at FROM rep""")
def j13_newest_first(spark, sf):
    return db.newest_first(_rep(spark, sf)).select("document_id", "main_topic", "content", "ner", "title",
                                                   "extracted_at")


@query("j14_longest_content", f"""WITH {ov.EXTRACTS}
SELECT DISTINCT document_id, content FROM extracts
WHERE (document_id, content_length) IN (SELECT document_id, max(content_length) FROM extracts GROUP BY 1)""")
def j14_longest_content(spark, sf):
    return db.longest_content(text.corpus(tb.extracts(spark, sf)))


@query("j16_topic_page_articles", f"""WITH {TOPIC_DOCS_SQL}
SELECT title, document_id AS article_id FROM td WHERE main_topic = 5""")
def j16_topic_page_articles(spark, sf):
    page = db.topic_page(tb.extracts(spark, sf), tb.topic_terms(spark, sf), 5)
    return page["articles"].select("title", "article_id")


@query("j17_entity_page_topics", f"""WITH {HITS_SQL}
SELECT main_topic, CAST(count(*) AS BIGINT) AS n_docs FROM hitd GROUP BY main_topic""")
def j17_entity_page_topics(spark, sf):
    page = db.entity_page(tb.extracts(spark, sf), tb.topic_terms(spark, sf), KW)
    return page["per_topic"]


@query("j16_topic_page_days", f"""WITH {REP_SQL}
SELECT main_topic, CAST(extracted_at AS DATE) AS day, CAST(count(*) AS BIGINT) AS n_docs
FROM rep WHERE main_topic = 5 GROUP BY ALL""")
def j16_topic_page_days(spark, sf):
    return db.topic_page(tb.extracts(spark, sf), tb.topic_terms(spark, sf), 5)["per_day"]


@query("j17_entity_page_articles", f"""WITH {HITS_SQL}
SELECT DISTINCT title, document_id AS article_id FROM hits""")
def j17_entity_page_articles(spark, sf):
    page = db.entity_page(tb.extracts(spark, sf), tb.topic_terms(spark, sf), KW)
    return page["articles"].select("title", "article_id")


# ---------------------------------------------------- J2, J4 by cycle

def _counted(spark, sf):
    """All extracts through the counts stream in four cycles, documents spread over them."""
    work = f"{ensure_checkpoint_dir(spark)}/counts/{uuid.uuid4().hex}"
    columns = ["extract_id", "document_id", "content_length", "main_topic", "extracted_at"]
    tb.extracts(spark, sf).select(*columns).repartition(4, "extract_id").write.parquet(f"{work}/in")
    counts.run_counts_stream(spark, f"{work}/in", f"{work}/store", f"{work}/checkpoint", files_per_cycle=1).awaitTermination()
    return counts.open_store(spark, f"{work}/store")


@query("j2_docs_per_topic_by_cycle", f"""WITH {REP_SQL}
SELECT main_topic, CAST(count(*) AS BIGINT) AS n_docs FROM rep GROUP BY main_topic""")
def j2_docs_per_topic_by_cycle(spark, sf):
    return counts.docs_per_topic(_counted(spark, sf))


@query("j4_docs_per_day_by_cycle", f"""WITH {REP_SQL}
SELECT main_topic, CAST(extracted_at AS DATE) AS day, CAST(count(*) AS BIGINT) AS n_docs FROM rep GROUP BY ALL""")
def j4_docs_per_day_by_cycle(spark, sf):
    return counts.docs_per_day(_counted(spark, sf))


@query("j16_topic_page_keywords", f"""WITH {ov.TOPIC_TERMS},
top AS (SELECT topic, term, weight, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank
        FROM topic_terms QUALIFY rank <= 20)
SELECT topic, term, CAST(rank AS INTEGER) AS rank, CAST(floor(floor(weight * 1000) / 2) AS BIGINT) AS size FROM top WHERE topic = 5""")
def j16_topic_page_keywords(spark, sf):
    page = db.topic_page(tb.extracts(spark, sf), tb.topic_terms(spark, sf), 5)
    return page["keywords"].join(page["cloud"], ["topic", "term"]).select("topic", "term", "rank", "size")


@query("j17_entity_page_keywords", f"""WITH {HITS_SQL}, {ov.TOPIC_TERMS},
top AS (SELECT topic, term, weight, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank
        FROM topic_terms QUALIFY rank <= 20)
SELECT topic, term, CAST(rank AS INTEGER) AS rank FROM top WHERE topic IN (SELECT main_topic FROM hitd)""")
def j17_entity_page_keywords(spark, sf):
    page = db.entity_page(tb.extracts(spark, sf), tb.topic_terms(spark, sf), KW)
    return page["keywords"].select("topic", "term", "rank")
