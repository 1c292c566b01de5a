"""Bounded samples of labelled texts for the two classifiers.

The only data that the classifiers fit on: at most ``rows_per_class`` labelled
rows of each class, and at most ``byte_budget`` bytes of whole texts, both
documented parameters.  Rows are taken in the order of a hash of the id, so
the same table always gives the same sample; a text that does not fit what is
left of the budget is passed over.
"""

from __future__ import annotations

import math
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labels are learned only from rows with crc32(id as text) mod 3 other than this.
FOLDS, HELD_OUT = 3, 1
#: Texts above this part of a class's byte budget are taken last.
LARGE = 16


def held_out(col: str = "doc_id"):
    return F.coalesce(common.crc_mod(col, FOLDS) == HELD_OUT, F.lit(False))


def sample_texts(docs: DataFrame, labels: DataFrame, label_col: str, rows_per_class: int,
                 byte_budget: int) -> tuple[pa.Table, float]:
    """A table (label, text) on the driver, and by how much the log odds of
    label 1 among all training labels exceed those in the sample, which a
    model's intercept has to make up for.  Contradicting labels of one id
    count as the lesser; null ids, labels other than 0 and 1 and null texts
    take no part; an id counts once, with the shortest of its texts.

    Where a class has no row, nothing is learned: a warning says so and the
    sample is empty.  Where none of its texts fits the budget, that is an error."""
    rows = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("label"))
            .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
            .groupBy("doc_id").agg(F.min("label").alias("label"))
            .filter(~held_out()))
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.octet_length("text").alias("n"),
                         F.xxhash64("text").alias("digest"))
             .filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()))
    least = texts.groupBy("doc_id").agg(F.min(F.struct("n", "digest")).alias("least"))
    found = common.saved(rows.join(least, "doc_id").select("doc_id", "label", "least.n", "least.digest"), "label-sizes")
    budget = byte_budget // 2
    chosen, empty = [], []
    for value in (0, 1):
        mine = found.filter(F.col("label") == value)
        order = (mine.filter(F.col("n") <= budget).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
                 .select("doc_id", "label", "n", "digest").collect())
        if not order:
            if not mine.isEmpty():
                raise ValueError(f"no text with {label_col} = {value} fits {budget} bytes: raise byte_budget")
            empty.append(value)
        chosen += [order[k] for k in _whole_texts([r["n"] for r in order], budget)]
    if len(empty) == 1:
        warnings.warn(f"no training text with {label_col} = {empty[0]}: nothing is learned", RuntimeWarning, stacklevel=2)
        chosen = []
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["label"], r["digest"]) for r in chosen],
                                            "doc_id bigint, label int, digest bigint")
    sample = common.saved(texts.join(F.broadcast(ids), ["doc_id", "digest"]).dropDuplicates(["doc_id"])
                          .select("label", "text", F.xxhash64("doc_id").alias("k")), "label-texts")
    sample = sample.orderBy("k", "label").select("label", "text").toArrow()
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = sample.column("label").to_pylist()
    shift = 0.0
    if min(n.get(0, 0), n.get(1, 0), got.count(0), got.count(1)) > 0:
        shift = math.log(n[1] / n[0]) - math.log(got.count(1) / got.count(0))
    return sample, shift


def _whole_texts(sizes: list[int], budget: int) -> list[int]:
    """Which texts of the given order are taken: those that fit what is left of
    the budget, where texts above a ``LARGE``-th of it come after the others."""
    out, left = [], budget
    for large in (False, True):
        for k, n in enumerate(sizes):
            if (n * LARGE > budget) == large and n <= left:
                out.append(k)
                left -= n
    return sorted(out)
