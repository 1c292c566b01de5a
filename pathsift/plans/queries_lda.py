"""Registered LDA queries (I1, I2, I5-I8): rows-only, no SQL twin.

The fitted model is kept per session and input folder, like the original
loading its model once per process.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.constants import LDA_PASSES, LDA_TOPICS
from ..operators import text, topics
from ..session import ensure_checkpoint_dir
from ..sources import tables as tb
from .registry import query

_MODELS: dict = {}
SINCE = "2024-01-15"


def _tokens(spark, sf):
    return topics.token_frame(tb.table(spark, sf, "documents"), "doc_id", "text")


def _stored(spark, sf):
    """The fitted model and the shared folder it is stored in."""
    key = (spark.conf.get("spark.app.id"), sf)
    if key not in _MODELS:
        model = topics.fit_lda(_tokens(spark, sf), k=LDA_TOPICS, passes=LDA_PASSES)
        path = f"{ensure_checkpoint_dir(spark)}/topic-models/{uuid.uuid4().hex}"
        topics.save_model(model, path)
        _MODELS[key] = (model, path)
    return _MODELS[key]


def _model(spark, sf):
    return _stored(spark, sf)[0]


def _parameters(spark, sf):
    """Topic-term parameters and vocabulary of the stored model."""
    model, path = _stored(spark, sf)
    return topics.stored_lambda(spark, path, model.name), topics.stored_vocabulary(spark, path, model.name)


@query("i1_lda_topic_terms")
def i1_lda_topic_terms(spark, sf):
    """I1 + I5: full normalised topic-term weights of the fitted model."""
    return topics.topic_term_weights(*_parameters(spark, sf))


@query("i6_main_topic")
def i6_main_topic(spark, sf):
    return topics.main_topics(_model(spark, sf), _tokens(spark, sf))


@query("i7_write_back_topics")
def i7_write_back_topics(spark, sf):
    doc_topics = topics.main_topics(_model(spark, sf), _tokens(spark, sf))
    ex = tb.extracts(spark, sf).withColumn("main_topic", F.lit(None).cast("int"))
    return topics.write_back_topics(ex, doc_topics, only_missing=True).select(
        "extract_id", "document_id", "main_topic")


@query("i8_online_update")
def i8_online_update(spark, sf):
    """One online step with extracts newer than the model (H2), vocabulary fixed."""
    lam, vocab = _parameters(spark, sf)
    new = text.corpus(tb.extracts(spark, sf), since=SINCE)
    toks = text.doc_tokens(new, "content", "document_id").withColumnRenamed("document_id", "doc_id")
    bow = toks.join(vocab.withColumnRenamed("term", "token"), "token").groupBy("doc_id", "term_index") \
              .agg(F.count("*").cast("double").alias("n"))
    n_docs = tb.table(spark, sf, "documents").count()
    return topics.online_update(lam, bow, LDA_TOPICS, n_docs, rho=topics.step_size(LDA_PASSES))


@query("i2_topic_count_sweep")
def i2_topic_count_sweep(spark, sf):
    return topics.topic_count_sweep(_tokens(spark, sf), [10, LDA_TOPICS, 30], passes=LDA_PASSES)
