"""Extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import EMPTY, TRAIN_DOC_LIMIT, XPATH_TYPE
from . import dom


def model_rounds(train: DataFrame, model: DataFrame) -> DataFrame:
    """For each training round, the latest round at or before it that
    produced a model (a failed fit keeps the previous content paths)."""
    has = model.select("domain", F.col("seq").alias("m")).distinct()
    w = Window.partitionBy("domain").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return (train.select("domain", "seq").join(has, (train.domain == has.domain) & (train.seq == has.m), "left")
            .select(train.domain, train.seq, "m")
            .withColumn("model_seq", F.last("m", ignorenulls=True).over(w))
            .filter(F.col("model_seq").isNotNull()).select("domain", "seq", "model_seq"))


def page_model(pages_df: DataFrame, train: DataFrame, model: DataFrame,
               limit: int = TRAIN_DOC_LIMIT) -> DataFrame:
    """``(page_id, domain, model_seq)``: the model each page is extracted with.

    A page of round ``k <= limit`` is extracted right after training on it;
    later pages use the model of round ``limit``.  The lookups have at most
    ``limit`` rows a domain; whether they are broadcast is Spark's choice by
    their size in bytes, and a hot domain is split by AQE otherwise.
    """
    p = (pages_df.select("page_id", "domain")
         .join(train.select("page_id", "seq"), "page_id", "left")
         .withColumn("seq", F.coalesce("seq", F.lit(limit))))
    return p.join(model_rounds(train, model), ["domain", "seq"]).select("page_id", "domain", "model_seq")


def content_items(nodes: DataFrame, pages_model: DataFrame, model: DataFrame,
                  text_col: str = "direct_text") -> DataFrame:
    """Texts of every content path on every page: ``(page_id, domain, path,
    item, no_text)``."""
    cp = (model.filter("is_content")
          .select("domain", F.col("seq").alias("model_seq"), "path",
                  dom.path_tags(F.col("path")).alias("tag_path"),
                  dom.path_indexes(F.col("path")).alias("idx_path")))
    n = nodes.select("page_id", "tag_path", "pos_path", F.col(text_col).alias("item"), "no_text") \
             .join(pages_model, "page_id")
    return (n.join(cp, ["domain", "model_seq", "tag_path"])
            .filter(dom.match_condition())
            .select("page_id", "domain", "path", "item", "no_text").distinct())


def longest_extract(items: DataFrame, keep_empty: bool = False) -> DataFrame:
    """F1 + F2 + F3: one extract per page, the longest text (UTF-8 bytes after
    ``"`` -> ``'``) over all content paths; ties by path, then text.

    Nodes without text never win over real text; a page with nothing else
    yields no row unless ``keep_empty``.  A text that reads like the sentinel
    is a text where ``no_text`` says so.
    """
    if not keep_empty:
        items = items.filter(~F.col("no_text") if "no_text" in items.columns else F.col("item") != EMPTY)
    it = items.select("page_id", "domain",
                      F.translate("path", '"', "'").alias("xpath"),
                      F.translate("item", '"', "'").alias("content"))
    it = it.withColumn("content_length", F.octet_length("content").cast("int"))
    best = F.min(F.struct((-F.col("content_length")).alias("nl"), "xpath", "content")).alias("b")
    return (it.groupBy("page_id", "domain").agg(best)
            .select("page_id", "domain", "b.xpath", "b.content", (-F.col("b.nl")).alias("content_length")))


def page_outcomes(pages_df: DataFrame, main: DataFrame, model: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row per page: ``extracted``, and where it is false the ``reason``:
    ``parse_error`` (the markup can't be parsed to its end, as the marks among
    ``nodes`` say; without ``nodes``, pages with ``html`` but no extract are
    parsed here), ``no_model`` (its domain never gave content paths) or ``no_text``."""
    out = pages_df.select("page_id", "domain").join(
        main.select("page_id").withColumn("extracted", F.lit(True)), "page_id", "left")
    out = out.join(model.select("domain").distinct().withColumn("_known", F.lit(True)), "domain", "left")
    if nodes is None and "html" in pages_df.columns:
        rest = pages_df.select("page_id", "html").join(main.select("page_id"), "page_id", "left_anti")
        nodes = dom.explode_nodes(rest, modes=(), marks=True)
    if nodes is not None:
        broken = nodes.filter("failed").select("page_id").distinct().withColumn("_broken", F.lit(True))
        out = out.join(broken, "page_id", "left")
    else:
        out = out.withColumn("_broken", F.lit(None).cast("boolean"))
    return out.select("page_id", "domain", F.coalesce("extracted", F.lit(False)).alias("extracted"),
                      F.when(F.col("extracted"), F.lit(None)).when(F.col("_broken"), F.lit("parse_error"))
                      .when(F.col("_known"), F.lit("no_text")).otherwise(F.lit("no_model")).alias("reason"))


def extract_records(main: DataFrame, titles: DataFrame | None = None,
                    topics: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """the stored extract row (M3): path, text, document, type, length,
    topic, title, entities.  ``topics``/``entities`` are keyed by ``page_id``."""
    r = main.withColumn("xpath_type", F.lit(XPATH_TYPE))
    r = r.join(titles, "page_id", "left") if titles is not None else r.withColumn("title", F.lit(None).cast("string"))
    r = r.join(topics, "page_id", "left") if topics is not None else r.withColumn("main_topic", F.lit(None).cast("int"))
    r = r.join(entities, "page_id", "left") if entities is not None else r.withColumn("ner", F.lit(None).cast("string"))
    return r.select(F.col("page_id").alias("document_id"), "domain", "xpath", "content", "xpath_type",
                    "content_length", "main_topic", "title", "ner")


def backfill_length(extracts: DataFrame) -> DataFrame:
    """fill missing lengths with the UTF-8 byte length of the content."""
    return extracts.withColumn("content_length",
                               F.coalesce("content_length", F.octet_length("content").cast("int")))
