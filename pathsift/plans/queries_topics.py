"""Registered queries for the topic reports (I3, I4, I9-I15) on topic_terms."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import text, topics
from ..operators import topic_reports as tr
from ..session import ensure_checkpoint_dir
from ..sources import tables as tb
from ..sources.snapshots import KeyedTable
from . import oracle_views as ov
from .registry import query

QW_SQL = "qw AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{w}')" for k, w in tb.QUERY_WORDS) + \
    ") AS t(key, word))"
STOP = ov.STOP_SQL


def _top_sql(n, weight="weight", src="topic_terms", stop=False):
    where = f"WHERE NOT list_contains({STOP}, trim(term))" if stop else ""
    return (f"SELECT topic, trim(term) AS term, {weight} AS weight, row_number() OVER (PARTITION BY topic "
            f"ORDER BY {weight} DESC, trim(term)) AS rank FROM {src} {where} QUALIFY rank <= {n}")


@query("i3_topic_top_terms", f"""WITH {ov.TOPIC_TERMS}, t AS ({_top_sql(20)})
SELECT topic, term, round(weight, 8) AS weight, CAST(rank AS INTEGER) AS rank FROM t WHERE topic = 0""")
def i3_topic_top_terms(spark, sf):
    t = tr.top_terms(tb.topic_terms(spark, sf), 20, topic=0)
    return t.select("topic", "term", F.round("weight", 8).alias("weight"), "rank")


@query("i4_all_topics_top_terms", f"""WITH {ov.TOPIC_TERMS}, t AS ({_top_sql(100)})
SELECT topic, term, round(weight, 8) AS weight, CAST(rank AS INTEGER) AS rank FROM t""")
def i4_all_topics_top_terms(spark, sf):
    t = tr.top_terms(tb.topic_terms(spark, sf), 100)
    return t.select("topic", "term", F.round("weight", 8).alias("weight"), "rank")


@query("i9_cloud_sizes", f"""WITH {ov.TOPIC_TERMS}, t AS ({_top_sql(20)})
SELECT topic, term, CAST(floor(floor(weight * 1000) / 2) AS BIGINT) AS size FROM t""")
def i9_cloud_sizes(spark, sf):
    return tr.cloud_sizes(tr.top_terms(tb.topic_terms(spark, sf), 20))


def _overlap_sql(src, weight, n=100):
    return f"""t AS ({_top_sql(n, weight, src, stop=True)}),
hit AS (SELECT DISTINCT qw.key, t.topic FROM t JOIN qw ON qw.word = t.term)"""


@query("i10_topic_overlaps", f"""WITH {ov.TOPIC_TERMS}, {QW_SQL}, {_overlap_sql('topic_terms', 'weight')}
SELECT hit.key, hit.topic, string_agg(t.term, ', ' ORDER BY t.rank) AS terms
FROM hit JOIN t USING (topic) GROUP BY hit.key, hit.topic""")
def i10_topic_overlaps(spark, sf):
    return tr.topic_overlaps(tb.topic_terms(spark, sf), tb.query_words(spark))


@query("i11_unique_query_terms", f"""WITH {ov.TOPIC_TERMS}, {QW_SQL}, {_overlap_sql('topic_terms', 'weight')}
SELECT hit.key, array_to_string(list_sort(list_distinct(list(t.term))), ', ') AS terms
FROM hit JOIN t USING (topic) GROUP BY hit.key""")
def i11_unique_query_terms(spark, sf):
    return tr.unique_query_terms(tb.topic_terms(spark, sf), tb.query_words(spark))


NORM_SQL = """tot AS (SELECT term, sum(weight) AS s FROM topic_terms GROUP BY term),
nw AS (SELECT t.topic, t.term, CASE WHEN tot.s = 0 THEN 0.0 ELSE t.weight / tot.s END AS norm_weight
       FROM topic_terms t JOIN tot USING (term))"""


@query("i12_normalized_weights", f"""WITH {ov.TOPIC_TERMS}, {NORM_SQL}
SELECT topic, term, round(norm_weight, 8) AS norm_weight,
       CAST(row_number() OVER (PARTITION BY topic ORDER BY round(norm_weight, 12) DESC, term) AS INTEGER) AS rank FROM nw""")
def i12_normalized_weights(spark, sf):
    n = tr.normalized_weights(tb.topic_terms(spark, sf))
    return n.select("topic", "term", F.round("norm_weight", 8).alias("norm_weight"), "rank")


@query("i13_normalized_overlaps", f"""WITH {ov.TOPIC_TERMS}, {QW_SQL}, {NORM_SQL},
{_overlap_sql('nw', 'norm_weight')}
SELECT hit.key, hit.topic, string_agg(t.term, ', ' ORDER BY t.rank) AS terms
FROM hit JOIN t USING (topic) GROUP BY hit.key, hit.topic""")
def i13_normalized_overlaps(spark, sf):
    return tr.normalized_overlaps(tb.topic_terms(spark, sf), tb.query_words(spark))[0]


@query("i13_normalized_unique_terms", f"""WITH {ov.TOPIC_TERMS}, {QW_SQL}, {NORM_SQL},
{_overlap_sql('nw', 'norm_weight')}
SELECT hit.key, array_to_string(list_sort(list_distinct(list(t.term))), ', ') AS terms
FROM hit JOIN t USING (topic) GROUP BY hit.key""")
def i13_normalized_unique_terms(spark, sf):
    return tr.normalized_overlaps(tb.topic_terms(spark, sf), tb.query_words(spark))[1]


DIST_SQL = """sq AS (SELECT topic, sum(weight * weight) AS nn FROM topic_terms GROUP BY topic),
dot AS (SELECT a.topic AS topic_a, b.topic AS topic_b, sum(a.weight * b.weight) AS dot
        FROM topic_terms a JOIN topic_terms b USING (term) GROUP BY 1, 2),
dist AS (SELECT na.topic AS topic_a, nb.topic AS topic_b,
         sqrt(greatest(na.nn + nb.nn - 2 * coalesce(dot, 0.0), 0.0)) AS distance
         FROM sq na CROSS JOIN sq nb LEFT JOIN dot ON topic_a = na.topic AND topic_b = nb.topic)"""


@query("i14_topic_distances", f"""WITH {ov.TOPIC_TERMS}, {DIST_SQL}
SELECT topic_a, topic_b, round(distance, 8) AS distance FROM dist""")
def i14_topic_distances(spark, sf):
    d = tr.topic_distances(tb.topic_terms(spark, sf))
    return d.select("topic_a", "topic_b", F.round("distance", 8).alias("distance"))


@query("i15_similar_topics", f"""WITH {ov.TOPIC_TERMS}, {DIST_SQL},
best AS (SELECT topic_a, topic_b, distance, row_number() OVER (PARTITION BY topic_a ORDER BY distance, topic_b) AS rank
         FROM dist WHERE topic_a <> topic_b QUALIFY rank <= 5),
t AS ({_top_sql(100)}),
terms AS (SELECT topic AS topic_b, string_agg(term, ', ' ORDER BY rank) AS terms FROM t GROUP BY 1)
SELECT topic_a, CAST(rank AS INTEGER) AS rank, topic_b, round(distance, 8) AS distance, terms
FROM best LEFT JOIN terms USING (topic_b)""")
def i15_similar_topics(spark, sf):
    tt = tb.topic_terms(spark, sf)
    s = tr.similar_topics(tr.topic_distances(tt), tt)
    return s.select("topic_a", "rank", "topic_b", F.round("distance", 8).alias("distance"), "terms")



@query("a10_report_lines", f"""WITH {ov.TOPIC_TERMS}, {QW_SQL}, {_overlap_sql('topic_terms', 'weight')},
o AS (SELECT hit.key, hit.topic, string_agg(t.term, ', ' ORDER BY t.rank) AS terms
      FROM hit JOIN t USING (topic) GROUP BY hit.key, hit.topic)
SELECT key || ';' || topic || ';' || terms AS line FROM o""")
def a10_report_lines(spark, sf):
    from ..sources.store import report_lines
    return report_lines(tr.topic_overlaps(tb.topic_terms(spark, sf), tb.query_words(spark)))


# ---------------------------------------------------- I6, I7 over a stored distribution

def best_topic_sql(rows: str, key: str, content: str) -> str:
    """CTEs ``bt`` with the best topic of each row's own tokens."""
    return f"""bt0 AS (SELECT {key} AS id, unnest({ov.clean_tokens_sql(content)}) AS term FROM {rows}),
bt1 AS (
  SELECT id, topic, sum(CAST(floor(weight * 1000000000) AS BIGINT)) AS score
  FROM bt0 JOIN topic_terms USING (term) GROUP BY id, topic),
bt AS (SELECT id, topic FROM bt1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, topic) = 1)"""


def best_topics_of(spark, sf, rows, id_col, text_col, ids=None):
    """The best topic of each row; ``ids``: the rows' ids, where they are at hand."""
    blocks = topics.score_blocks(rows.select(id_col) if ids is None else ids)
    counts = text.term_counts(text.doc_tokens(rows, text_col, id_col), id_col)
    return topics.best_topics(rows, topics.topic_scores(counts, tb.topic_terms(spark, sf), id_col, blocks), id_col)


@query("i6_main_topic_stored", f"""WITH {ov.TOPIC_TERMS}, {best_topic_sql('documents', 'doc_id', 'text')}
SELECT d.doc_id, CAST(coalesce(bt.topic, 0) AS INTEGER) AS main_topic
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN bt ON bt.id = d.doc_id""")
def i6_main_topic_stored(spark, sf):
    """I6 over the stored topic-term table."""
    return best_topics_of(spark, sf, tb.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@query("i7_topics_of_extracts", f"""WITH {ov.TOPIC_TERMS}, {ov.EXTRACTS}, {best_topic_sql('extracts', 'extract_id', 'content')}
SELECT e.extract_id, e.document_id, e.content_length,
       CAST(CASE WHEN e.content_length % 2 = 1 THEN e.main_topic ELSE coalesce(bt.topic, 0) END AS INTEGER) AS main_topic
FROM extracts e LEFT JOIN bt ON bt.id = e.extract_id""")
def i7_topics_of_extracts(spark, sf):
    """Topic per extract, merged into a half-filled table (extracts of even
    length have none yet) as a new version."""
    ex = tb.extracts(spark, sf)
    table = KeyedTable(spark, f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}",
                       "extract_id long, document_id long, content_length int, main_topic int", "extract_id")
    table.create(ex.withColumn("main_topic", F.when(F.col("content_length") % 2 == 1, F.col("main_topic"))))
    missing = table.read().filter("main_topic IS NULL").select("extract_id")
    rows = ex.select("extract_id", "content").join(missing, "extract_id", "left_semi")
    table.update(best_topics_of(spark, sf, rows, "extract_id", "content", missing), ["main_topic"], only_missing=True)
    return table.read()


# ---------------------------------------------------- I13 with words that hit

OWN_WORDS_SQL = """qw AS (
  SELECT 'topic ' || min(topic) AS key, term AS word FROM topic_terms GROUP BY term HAVING count(DISTINCT topic) = 1
  QUALIFY row_number() OVER (PARTITION BY min(topic) ORDER BY term) <= 3)"""


def _own_words(terms):
    """Query words: of each topic the first three terms that no other topic has."""
    own = terms.groupBy("term").agg(F.min("topic").alias("topic"), F.countDistinct("topic").alias("n")).filter("n = 1")
    w = Window.partitionBy("topic").orderBy("term")
    return own.withColumn("r", F.row_number().over(w)).filter("r <= 3").select(
        F.concat(F.lit("topic "), F.col("topic").cast("string")).alias("key"), F.col("term").alias("word"))


@query("i13_overlaps_of_own_words", f"""WITH {ov.TOPIC_TERMS}, {OWN_WORDS_SQL}, {NORM_SQL},
{_overlap_sql('nw', 'norm_weight')}
SELECT hit.key, hit.topic, string_agg(t.term, ', ' ORDER BY t.rank) AS terms
FROM hit JOIN t USING (topic) GROUP BY hit.key, hit.topic""")
def i13_overlaps_of_own_words(spark, sf):
    terms = tb.topic_terms(spark, sf)
    return tr.normalized_overlaps(terms, _own_words(terms))[0]


@query("i13_unique_terms_of_own_words", f"""WITH {ov.TOPIC_TERMS}, {OWN_WORDS_SQL}, {NORM_SQL},
{_overlap_sql('nw', 'norm_weight')}
SELECT hit.key, array_to_string(list_sort(list_distinct(list(t.term))), ', ') AS terms
FROM hit JOIN t USING (topic) GROUP BY hit.key""")
def i13_unique_terms_of_own_words(spark, sf):
    terms = tb.topic_terms(spark, sf)
    return tr.normalized_overlaps(terms, _own_words(terms))[1]
