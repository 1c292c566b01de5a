"""Registered queries for groups F5-F11, G and H (documents in)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import entities, stats, text
from ..session import ensure_checkpoint_dir
from ..sources import tables as tb
from ..sources.cycles import CycleStore
from . import oracle_views as ov
from .registry import query

SINCE = "2024-01-15"


@query("h1_corpus", f"""WITH {ov.EXTRACTS}
SELECT extract_id, document_id, content_length FROM extracts
WHERE (document_id, content_length) IN (SELECT document_id, max(content_length) FROM extracts GROUP BY 1)""")
def h1_corpus(spark, sf):
    return text.corpus(tb.extracts(spark, sf)).select("extract_id", "document_id", "content_length")


@query("h2_corpus_since", f"""WITH {ov.EXTRACTS}
SELECT extract_id, document_id, content_length FROM extracts
WHERE (document_id, content_length) IN (
  SELECT document_id, max(content_length) FROM extracts WHERE extracted_at >= TIMESTAMP '{SINCE}' GROUP BY 1)""")
def h2_corpus_since(spark, sf):
    return text.corpus(tb.extracts(spark, sf), since=SINCE).select("extract_id", "document_id", "content_length")


@query("h5_clean_tokens", f"""
SELECT doc_id AS document_id, token, CAST(count(*) AS BIGINT) AS n
FROM (SELECT doc_id, unnest({ov.clean_tokens_sql('text')}) AS token FROM documents) GROUP BY ALL""")
def h5_clean_tokens(spark, sf):
    d = tb.table(spark, sf, "documents").withColumnRenamed("doc_id", "document_id")
    t = text.doc_tokens(d, "text")
    return t.groupBy("document_id", "token").agg(F.count("*").cast("long").alias("n"))


VOCAB_SQL = f"""voc0 AS (SELECT doc_id, unnest({ov.clean_tokens_sql('text')}) AS token FROM documents),
vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS term_id, token AS term,
         CAST(count(DISTINCT doc_id) AS BIGINT) AS df
  FROM voc0 GROUP BY token)"""


def _counts(spark, sf):
    """Term counts of all documents, tokenized once and stored."""
    d = tb.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return tb.stored_view(spark, "term-counts", d, "document_id long, token string, n long",
                          lambda x: text.term_counts(text.doc_tokens(x, "text")))


@query("h6_vocabulary", f"WITH {VOCAB_SQL} SELECT term_id, term, df FROM vocab")
def h6_vocabulary(spark, sf):
    return text.vocabulary(_counts(spark, sf))


@query("h6_vocabulary_by_cycle", f"""WITH {ov.EXTRACTS},
tok AS (SELECT extracted_at < TIMESTAMP '{SINCE}' AS early, unnest({ov.clean_tokens_sql('content')}) AS term FROM extracts),
seen AS (SELECT term, bool_or(early) AS early FROM tok GROUP BY term)
SELECT term, row_number() OVER (ORDER BY early DESC, term) - 1 AS term_id FROM seen""")
def h6_vocabulary_by_cycle(spark, sf):
    """Extracts of two halves of the month as two cycles: ids of the first stay."""
    work = f"{ensure_checkpoint_dir(spark)}/vocabulary/{uuid.uuid4().hex}"
    store = CycleStore(spark, work, text.VOCABULARY_TABLES)
    ex = tb.extracts(spark, sf)
    early = F.col("extracted_at") < F.lit(SINCE).cast("timestamp")
    for cycle, part in enumerate([ex.filter(early), ex.filter(~early)]):
        attempt = store.begin(cycle)
        text.vocabulary_cycle(store, attempt, text.term_counts(text.doc_tokens(part)))
        attempt.commit()
    return store.table("terms")


@query("h7_bag_of_words", f"""WITH {VOCAB_SQL}
SELECT v.doc_id AS document_id, vocab.term_id, CAST(count(*) AS BIGINT) AS n
FROM voc0 v JOIN vocab ON vocab.term = v.token GROUP BY ALL""")
def h7_bag_of_words(spark, sf):
    counts = _counts(spark, sf)
    return text.bag_of_words(counts, text.vocabulary(counts))


ISLANDS_SQL = f"""{ov.TOKENS},
isl0 AS (
  SELECT doc_id, sent, pos, trim(trim(token, '"'), '''') AS tok,
         pos - row_number() OVER (PARTITION BY doc_id, sent ORDER BY pos) AS grp
  FROM tokens WHERE tag IN ('PERSON', 'ORGANIZATION')),
islands AS (
  SELECT doc_id, sent, CAST(min(pos) AS INTEGER) AS start, string_agg(tok, ' ' ORDER BY pos) AS phrase
  FROM isl0 GROUP BY doc_id, sent, grp)"""


@query("f5_entity_phrases", f"WITH {ISLANDS_SQL} SELECT doc_id, sent, start, phrase FROM islands")
def f5_entity_phrases(spark, sf):
    return entities.merge_adjacent(tb.tokens(spark, sf))


@query("f6_entities_from_tokens", f"""WITH {ISLANDS_SQL}
SELECT doc_id, array_to_string(list_sort(list_distinct(list(phrase))), ',') AS ner FROM islands GROUP BY doc_id""")
def f6_entities_from_tokens(spark, sf):
    return entities.entities_from_tokens(tb.tokens(spark, sf))


GAZ_SQL = f"""{ov.TOKENS}, {ov.GAZETTEER},
gz AS (SELECT phrase, label, string_split(phrase, ' ') AS words FROM gazetteer),
place AS (SELECT doc_id, sent, ws, unnest(range(1, len(ws) + 1)) AS p FROM tk2),
hits AS (
  SELECT doc_id, CAST(sent AS INTEGER) AS sent, CAST(p - 1 AS INTEGER) AS start, len(words) AS n, phrase AS text, label
  FROM place JOIN gz ON ws[p] = words[1] AND ws[p:p + len(words) - 1] = words),
mentions AS (
  SELECT * FROM hits a WHERE NOT EXISTS (
    SELECT 1 FROM hits b WHERE b.doc_id = a.doc_id AND b.sent = a.sent AND b.start <= a.start
      AND b.start + b.n >= a.start + a.n AND b.n > a.n))"""


def _mentions(spark, sf):
    return entities.gazetteer_mentions(tb.tokens(spark, sf), tb.gazetteer(spark, sf))


@query("f8_gazetteer_mentions", f"""WITH {GAZ_SQL}
SELECT doc_id, sent, start, CAST(n AS INTEGER) AS n, text, label FROM mentions""")
def f8_gazetteer_mentions(spark, sf):
    return _mentions(spark, sf).withColumn("n", F.col("n").cast("int"))


@query("f7_entities_from_spans", f"""WITH {GAZ_SQL}
SELECT doc_id, array_to_string(list_sort(list_distinct(list(trim(trim(text, '"'), '''')))), ',') AS ner
FROM mentions WHERE label IN ('PERSON', 'ORG', 'WORK_OF_ART', 'PRODUCT') GROUP BY doc_id""")
def f7_entities_from_spans(spark, sf):
    return entities.entities_from_spans(_mentions(spark, sf))


def _listy(ner):
    """Stored entity strings in list-literal form: ['A', 'B'] (or [])."""
    q = F.transform(F.filter(F.split(ner, ","), lambda x: x != ""), lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(q, ", "), F.lit("]"))


LISTY_SQL = ("'[' || array_to_string(list_transform(list_filter(string_split(ner, ','), lambda x: x <> ''), "
             "lambda x: '''' || x || ''''), ', ') || ']'")


@query("f9_entity_cleanup", f"""WITH {ov.EXTRACTS}, raw AS (SELECT extract_id, {LISTY_SQL} AS ner FROM extracts)
SELECT extract_id, ner, CASE WHEN length(ner) > 2 THEN array_to_string(list_sort(list_distinct(list_transform(
  string_split(ner, ','), lambda x: regexp_replace(trim(trim(trim(trim(x, '"'), ''''), '['), ']'), '[''"]', '', 'g')))), ',')
  ELSE 'No NERs Recognized' END AS ner_clean
FROM raw WHERE ner LIKE '%[%]'""")
def f9_entity_cleanup(spark, sf):
    e = tb.extracts(spark, sf).select("extract_id", _listy(F.col("ner")).alias("ner"))
    return entities.cleanup_entity_string(e)


@query("f10_entity_list", f"""WITH {ov.EXTRACTS}
SELECT extract_id, list_transform(list_filter(string_split(ner, ','), lambda x: x <> ''),
  lambda x: trim(trim(x, '"'), '''')) AS ner_list FROM extracts""")
def f10_entity_list(spark, sf):
    return entities.parse_entity_list(tb.extracts(spark, sf), "ner", 1).select("extract_id", "ner_list")


@query("f11_backfill_length", f"""WITH {ov.EXTRACTS}
SELECT extract_id, CAST(strlen(content) AS INTEGER) AS content_length FROM extracts""")
def f11_backfill_length(spark, sf):
    from ..operators.extract import backfill_length
    e = tb.extracts(spark, sf).withColumn("content_length", F.lit(None).cast("int"))
    return backfill_length(e).select("extract_id", "content_length")


def _r(c):
    return F.round(c, 6).alias(c) if isinstance(c, str) else c


STAT_SQL_COLS = """CAST(count(content_length) AS BIGINT) AS count, round(avg(content_length), 6) AS mean,
  round(stddev_samp(content_length), 6) AS std, CAST(min(content_length) AS DOUBLE) AS min, {pcts},
  CAST(max(content_length) AS DOUBLE) AS max"""


def _pct_sql(ps):
    return ", ".join(f"round(quantile_cont(content_length, {p}), 6) AS p{int(round(p * 100)):02d}" for p in ps)


@query("g1_path_length_stats", f"""WITH {ov.EXTRACTS}
SELECT domain, xpath, {STAT_SQL_COLS.format(pcts=_pct_sql(stats.PATH_PCTS))}
FROM extracts WHERE content_length IS NOT NULL GROUP BY domain, xpath""")
def g1_path_length_stats(spark, sf):
    g = stats.path_length_stats(tb.extracts(spark, sf))
    return g.select("domain", "xpath", "count", *[_r(c) for c in g.columns[3:]])


@query("g1_length_stats_of_asked_paths", f"""WITH {ov.EXTRACTS},
top AS (SELECT domain, max(CAST(substr(xpath, 3, length(xpath) - 3) AS INTEGER)) AS n FROM extracts GROUP BY domain),
asked AS (SELECT t.domain, 'p[' || i || ']' AS xpath FROM (SELECT max(n) AS m FROM top) x, range(1, m + 1) AS r(i), top t),
docs AS (SELECT DISTINCT document_id, domain FROM extracts WHERE extracted_at >= TIMESTAMP '{SINCE}'),
e AS (SELECT * FROM extracts SEMI JOIN docs USING (document_id, domain) WHERE content_length IS NOT NULL),
s AS (SELECT domain, xpath, {STAT_SQL_COLS.format(pcts=_pct_sql(stats.PATH_PCTS))} FROM e GROUP BY domain, xpath)
SELECT domain, xpath, coalesce(count, 1) AS count, CASE WHEN count IS NULL THEN 0.0 ELSE mean END AS mean, std,
       coalesce(min, 0.0) AS min, {", ".join(f"coalesce(p{int(round(q * 100)):02d}, 0.0) AS p{int(round(q * 100)):02d}" for q in stats.PATH_PCTS)},
       coalesce(max, 0.0) AS max
FROM asked LEFT JOIN s USING (domain, xpath)""")
def g1_length_stats_of_asked_paths(spark, sf):
    """Every path number in every domain, over the documents since a day; many have no rows."""
    ex = tb.extracts(spark, sf)
    number = F.regexp_extract("xpath", r"\[(\d+)\]", 1).cast("int")
    m = ex.agg(F.max(number).alias("m"))
    asked = (ex.select("domain").distinct().join(F.broadcast(m)).select("domain", F.explode(F.sequence(F.lit(1), "m")).alias("i"))
             .select("domain", F.concat(F.lit("p["), F.col("i").cast("string"), F.lit("]")).alias("xpath")))
    docs = ex.filter(F.col("extracted_at") >= F.lit(SINCE).cast("timestamp")).select("document_id", "domain").distinct()
    g = stats.path_length_stats(ex, docs, asked)
    return g.select("domain", "xpath", "count", *[_r(c) for c in g.columns[3:]])


@query("g2_domain_length_stats", f"""WITH {ov.EXTRACTS}
SELECT domain, {STAT_SQL_COLS.format(pcts=_pct_sql(stats.DOMAIN_PCTS))}
FROM extracts WHERE content_length IS NOT NULL GROUP BY domain""")
def g2_domain_length_stats(spark, sf):
    e = tb.extracts(spark, sf)
    g = stats.domain_length_stats(e, e.select("domain"))
    return g.select("domain", "count", *[_r(c) for c in g.columns[2:]])
