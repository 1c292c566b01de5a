"""Dashboard queries over the extract table (M3)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import RESULT_LIMIT, TOP_TERMS_APP
from .entities import parse_entity_list


def representative(extracts: DataFrame) -> DataFrame:
    """One extract per document -- the longest, then the lowest id."""
    w = Window.partitionBy("document_id").orderBy(F.col("content_length").desc_nulls_last(), "extract_id")
    return extracts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def docs_per_topic(rep: DataFrame) -> DataFrame:
    """Documents per topic, ordered by topic."""
    return rep.groupBy("main_topic").agg(F.count("*").cast("long").alias("n_docs")).orderBy("main_topic")


def topic_documents(rep: DataFrame, topic: int | None = None, limit: int | None = RESULT_LIMIT) -> DataFrame:
    """Documents of a topic, newest id first, ``limit`` rows per topic
    (every topic when ``topic`` is None; no limit when ``limit`` is None)."""
    r = rep if topic is None else rep.filter(F.col("main_topic") == topic)
    if limit is None:
        return r
    w = Window.partitionBy("main_topic").orderBy(F.col("document_id").desc())
    return r.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def docs_per_day(topic_docs: DataFrame) -> DataFrame:
    """Documents of each topic per day."""
    return topic_docs.groupBy("main_topic", F.to_date("extracted_at").alias("day")) \
                     .agg(F.count("*").cast("long").alias("n_docs"))


def entity_search(rep: DataFrame, keywords: Sequence[str], limit: int | None = RESULT_LIMIT) -> DataFrame:
    """Documents whose entity string contains a keyword (case-insensitive
    substring), the ``limit`` newest ids per keyword.  Keywords are a small
    literal list tested per row -- no join."""
    kws = F.array(*[F.lit(k.strip('"').strip("'").lower()) for k in keywords if k])
    lower = F.lower(F.coalesce(F.col("ner"), F.lit("")))
    hits = rep.withColumn("keyword", F.explode(F.filter(kws, lambda k: lower.contains(k))))
    if limit is None:
        return hits
    w = Window.partitionBy("keyword").orderBy(F.col("document_id").desc())
    return hits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def entity_hits(hits: DataFrame) -> DataFrame:
    """Union of keyword hits, one row per document (order by date at the edge)."""
    return hits.drop("keyword").dropDuplicates(["document_id"])


def hits_per_topic(hits_distinct: DataFrame) -> DataFrame:
    """Hit documents per topic."""
    return hits_distinct.groupBy("main_topic").agg(F.count("*").cast("long").alias("n_docs"))


def hit_topic_keywords(per_topic: DataFrame, topic_terms: DataFrame, n: int = TOP_TERMS_APP) -> DataFrame:
    """Top-``n`` keywords of every hit topic (shown by weight ascending)."""
    from .topic_reports import top_terms
    t = top_terms(topic_terms, n)
    return t.join(per_topic.select(F.col("main_topic").alias("topic")), "topic", "left_semi")


def chart_rows(df: DataFrame, label_col: str, value_col: str) -> DataFrame:
    """Chart data rows ``{"c":[{"v":label},{"v":value}]}``."""
    js = F.concat(F.lit('{"c":[{"v":"'), F.col(label_col).cast("string"), F.lit('"},{"v":'),
                  F.col(value_col).cast("string"), F.lit("}]}"))
    return df.select(F.col(label_col).cast("string").alias("label"),
                     F.col(value_col).cast("long").alias("value"), js.alias("row_json"))


def article_list(rows: DataFrame) -> DataFrame:
    """Article payload -- content, title, id, entity list, ``show=false``."""
    return parse_entity_list(rows, "ner", variant=1).select(
        "content", "title", F.col("document_id").alias("article_id"), "ner_list",
        F.lit(False).alias("show"))


def no_entity_count(extracts: DataFrame) -> DataFrame:
    """Extracts without entities (null, '' or a lone quote)."""
    c = F.col("ner")
    return extracts.filter(c.isNull() | c.isin("", "'")).agg(F.count("*").cast("long").alias("n"))


def with_entities(extracts: DataFrame) -> DataFrame:
    """Extracts that do have entities."""
    c = F.col("ner")
    return extracts.filter(c.isNotNull() & (c != "'") & (c != "")).select("extract_id", "document_id", "ner")


def newest_first(rep: DataFrame) -> DataFrame:
    """All representative documents, newest first."""
    return rep.orderBy(F.col("extracted_at").desc(), F.col("document_id").desc())


def longest_content(corpus_rows: DataFrame) -> DataFrame:
    """Distinct longest content per document."""
    return corpus_rows.select("document_id", "content").distinct()


def ordered(df: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Client-side ordering of a result table."""
    return df.orderBy(F.col(by).desc() if descending else F.col(by).asc())


def topic_page(extracts: DataFrame, topic_terms: DataFrame, topic: int) -> dict[str, DataFrame]:
    """J3 + J4 + I3 + I9 for one topic.  The article list is one page of
    ``RESULT_LIMIT`` rows; the days count all of the topic's documents."""
    from .topic_reports import cloud_sizes, top_terms
    rep = representative(extracts)
    docs = topic_documents(rep, topic, limit=None)
    terms = top_terms(topic_terms, TOP_TERMS_APP).filter(F.col("topic") == topic)
    return {"articles": article_list(topic_documents(rep, topic)), "per_day": docs_per_day(docs),
            "keywords": terms, "cloud": cloud_sizes(terms)}


def entity_page(extracts: DataFrame, topic_terms: DataFrame, keywords: Sequence[str]) -> dict[str, DataFrame]:
    """J5 + J6 + J7 + J8 for a keyword list.  The article list is one page of
    ``RESULT_LIMIT`` rows a keyword; topics count all hits."""
    rep = representative(extracts)
    page = entity_hits(entity_search(rep, keywords))
    per_topic = hits_per_topic(entity_hits(entity_search(rep, keywords, limit=None)))
    return {"articles": article_list(page), "per_topic": per_topic,
            "keywords": hit_topic_keywords(per_topic, topic_terms).orderBy("weight")}
