"""Path scoring and clustering, set-based over all domains.

The original trains one page at a time: every candidate path of the domain is
read on the page, each text item is compared with the path's *background*
(the sentinel ``'empty'`` plus every item seen on earlier training pages) by
normalised edit distance, the median per item and the mean over items give
the path's ratio, and a 2-means split of the ratios marks the paths whose
text changes from page to page as content.

Here every training round of every domain is computed at once:

* background = the distinct texts of the path with their number of pages
  ``first_seen <= j < k``, plus one ``'empty'``; text that every page repeats
  is one row, whatever the number of rounds;
* each distinct text pair is compared exactly once, on a repartitioned pair
  table, with bit vectors of many pairs at a time in a pandas UDF;
* medians are ``percentile(x, 0.5, count)``; the 2-means split is exact in one
  dimension, found from window prefix sums over the sorted distinct ratios.

The training gate of the original (train while the domain has fewer than 50
processed documents) bounds each domain to its first ``train_limit`` pages,
which also bounds every join key here.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import EMPTY, TRAIN_DOC_LIMIT
from ..functions.editdistance import levenshtein_batch
from ..session import default_parallelism
from . import dom


def text_id(c) -> F.Column:
    """Id of a text item: its SHA-256, since two texts that shared an id would
    share their distances, and its length, which the ratio needs."""
    return F.struct(F.unhex(F.sha2(c, 256)).alias("h"), F.length(c).alias("n"))


@F.pandas_udf(T.IntegerType())
def edit_distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(levenshtein_batch(a.tolist(), b.tolist()), dtype="int32")


# ------------------------------------------------------------------ inputs

def training_pages(pages_df: DataFrame, limit: int = TRAIN_DOC_LIMIT) -> DataFrame:
    """Pages trained on -- the first ``limit`` pages of each domain
    (``(domain, page_id, seq)``).  Bounded: at most ``limit`` rows per domain."""
    w = Window.partitionBy("domain").orderBy("page_id")
    return (pages_df.select("domain", "page_id").withColumn("seq", F.row_number().over(w))
            .filter(F.col("seq") <= limit))


def path_items_by_round(nodes_t: DataFrame, train: DataFrame) -> DataFrame:
    """D3 + D4 + D8 over training rounds: ``(domain, seq, path, item)``.

    Every candidate path known at round ``seq`` (first seen on a page
    ``<= seq``) is read on the page of that round.
    """
    cand = (dom.candidate_paths(nodes_t)
            .select("domain", F.col("abs_path").alias("path"), "first_seen", "tag_path", "idx_path"))
    evals = (cand.join(train.select("domain", "seq"), "domain")
             .filter(F.col("seq") >= F.col("first_seen"))
             .drop("first_seen"))
    return dom.path_items(nodes_t, evals, keys=("domain", "seq"))


# ------------------------------------------------------------------ E1/E2/E4

def pair_distances(pairs: DataFrame, texts: DataFrame, partitions: int) -> DataFrame:
    """Exact edit distance for each distinct unordered text pair.

    ``pairs``: ``(x, y)`` text ids; ``texts``: ``(tid, item)``.  The pair
    table is hash-repartitioned to a fixed partition count so the expensive
    comparisons spread over all executors even when the table is small in
    bytes (AQE would otherwise coalesce it into a single task).
    """
    tx = texts.select(F.col("tid").alias("x"), F.col("item").alias("xs"))
    ty = texts.select(F.col("tid").alias("y"), F.col("item").alias("ys"))
    # pairs of one text together (one pass over it serves them all), a frequent text in several pieces
    p = (pairs.join(tx, "x").join(ty, "y")
         .repartition(partitions, F.col("x"), F.pmod(F.hash("y"), F.lit(4))).sortWithinPartitions("x"))
    same = F.col("xs") == F.col("ys")
    return p.select("x", "y", F.when(same, F.lit(0)).otherwise(edit_distance_udf("xs", "ys")).alias("lev"))


def background(items: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Each item of round ``k`` with the texts of its path before that round
    and their number: ``(domain, path, k, a, b, w)``.  ``history`` holds the
    items of rounds trained before (nothing of it is scored again)."""
    it = items.select("domain", "path", "seq", text_id(F.col("item")).alias("tid"))
    past = it if history is None else it.unionByName(
        history.select("domain", "path", "seq", text_id(F.col("item")).alias("tid")))
    a = it.select("domain", "path", F.col("seq").alias("k"), F.col("tid").alias("a"))
    b = past.groupBy("domain", "path", F.col("tid").alias("b")).agg(F.collect_list("seq").alias("js"))
    bg = (a.join(b, ["domain", "path"])
          .withColumn("w", F.size(F.filter("js", lambda j: j < F.col("k")))).filter("w > 0")
          .select("domain", "path", "k", "a", "b", "w"))
    return bg.unionByName(a.select("domain", "path", "k", "a", text_id(F.lit(EMPTY)).alias("b"), F.lit(1).alias("w")))


def new_distances(bg: DataFrame, items: DataFrame, history: DataFrame | None = None,
                  known: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Distances of the text pairs of ``bg`` that aren't ``known`` yet: ``(x, y, lev)``."""
    spark = bg.sparkSession
    pairs = bg.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    if known is not None:
        pairs = pairs.join(known.select("x", "y"), ["x", "y"], "left_anti")
    texts = items.select("item") if history is None else items.select("item").unionByName(history.select("item"))
    texts = texts.unionByName(spark.range(1).select(F.lit(EMPTY).alias("item")))
    texts = texts.select(text_id(F.col("item")).alias("tid"), "item").dropDuplicates(["tid"])
    return pair_distances(pairs, texts, partitions or default_parallelism(spark))


def ratios_from(bg: DataFrame, items: DataFrame, distances: DataFrame, normalized: bool = True) -> DataFrame:
    """The ratios of ``bg``'s items from stored distances."""
    d = (bg.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b"))
         .join(distances, ["x", "y"])
         .select("domain", "path", "k", "a", "w",
                 (F.col("lev") * 2.0 / (F.col("a.n") + F.col("b.n"))).alias("d")))
    med = d.groupBy("domain", "path", "k", "a").agg(F.percentile("d", 0.5, F.col("w")).alias("med"))
    n_items = items.groupBy("domain", "path", "seq").agg(F.count("*").alias("n_items"))
    r = (med.groupBy("domain", "path", "k").agg(F.avg("med").alias("m"))
         .withColumnRenamed("k", "seq")
         .join(n_items, ["domain", "path", "seq"]))
    ratio = F.col("m") / F.col("n_items") if normalized else F.col("m")
    return r.select("domain", "path", "seq", "n_items", ratio.alias("ratio"))


def path_ratios(items: DataFrame, normalized: bool = True, partitions: int | None = None,
                distances: DataFrame | None = None) -> DataFrame:
    """Ratio of every (domain, path, round).

    ``items``: ``(domain, seq, path, item)`` with distinct items per round.
    Returns ``(domain, path, seq, n_items, ratio)``; with ``normalized`` each
    median is divided by the number of items (E2, the one in use), else E1.
    Stored ``distances`` of all pairs are not computed again.
    """
    bg = background(items)
    if distances is None:
        distances = new_distances(bg, items, partitions=partitions)
    return ratios_from(bg, items, distances, normalized)


#: By its formula the same ratio as E2.
ngram_ratios = path_ratios


# ------------------------------------------------------------------ E5

def ratio_history(ratios: DataFrame) -> DataFrame:
    """E5: ratio history per path (ordered by round) and the latest ratio."""
    return (ratios.groupBy("domain", "path")
            .agg(F.sort_array(F.collect_list(F.struct("seq", "ratio"))).alias("h"),
                 F.max_by("ratio", "seq").alias("latest_ratio"), F.max("seq").alias("latest_seq"))
            .select("domain", "path", F.col("h.ratio").alias("ratio_values"), "latest_ratio", "latest_seq"))


# ------------------------------------------------------------------ E6/E7

def two_means_split(values: DataFrame, keys: list[str], value_col: str = "ratio") -> DataFrame:
    """Exact 1-D 2-means per group.

    Sorted distinct values with running count, sum and sum of squares; the
    split after each distinct value has SSE ``S2 - S1^2/n`` on both sides; the
    smallest SSE wins (lowest threshold on ties).  Groups with one distinct
    value yield no row.  Returns ``keys + (threshold, lo_center, hi_center, sse)``.
    """
    g = (values.groupBy(*keys, F.col(value_col).alias("v"))
         .agg(F.count("*").alias("c"), F.sum(value_col).alias("s"),
              F.sum(F.col(value_col) * F.col(value_col)).alias("q")))
    w = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    wall = Window.partitionBy(*keys)
    g = (g.withColumn("c1", F.sum("c").over(w)).withColumn("s1", F.sum("s").over(w))
          .withColumn("q1", F.sum("q").over(w))
          .withColumn("cn", F.sum("c").over(wall)).withColumn("sn", F.sum("s").over(wall))
          .withColumn("qn", F.sum("q").over(wall))
          .filter(F.col("c1") < F.col("cn")))
    sse = ((F.col("q1") - F.col("s1") * F.col("s1") / F.col("c1"))
           + ((F.col("qn") - F.col("q1")) - (F.col("sn") - F.col("s1")) * (F.col("sn") - F.col("s1"))
              / (F.col("cn") - F.col("c1"))))
    g = g.select(*keys, F.col("v").alias("threshold"), sse.alias("sse"),
                 (F.col("s1") / F.col("c1")).alias("lo_center"),
                 ((F.col("sn") - F.col("s1")) / (F.col("cn") - F.col("c1"))).alias("hi_center"))
    best = Window.partitionBy(*keys).orderBy("sse", "threshold")
    return g.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def content_paths(ratios: DataFrame) -> DataFrame:
    """E6 + E7 + E10: path model per (domain, round).

    ``is_content`` = ratio above the split (the cluster with the larger
    centre).  With one distinct ratio every path is kept; a round with a
    single candidate path has no model (the 2-means fit is impossible).
    Returns ``(domain, seq, path, ratio, is_content, threshold, lo_center, hi_center)``.
    """
    keys = ["domain", "seq"]
    sizes = ratios.groupBy(*keys).agg(F.count("*").alias("n_paths"))
    split = two_means_split(ratios, keys)
    m = (ratios.join(sizes, keys).filter(F.col("n_paths") >= 2)
         .join(split, keys, "left"))
    return m.select("domain", "seq", "path", "ratio",
                    F.coalesce(F.col("ratio") > F.col("threshold"), F.lit(True)).alias("is_content"),
                    "threshold", "lo_center", "hi_center")


def warm_start_step(ratios: DataFrame, centroids: DataFrame, steps: int = 1) -> DataFrame:
    """Lloyd steps from stored centres ``(domain, lo_center, hi_center)``:
    assign each ratio to the nearer centre, re-average.  Returns the new
    centres and the assignment of the last step."""
    cur = centroids
    assigned = None
    for _ in range(steps):
        assigned = (ratios.join(cur, "domain")
                    .withColumn("is_content", F.abs(F.col("ratio") - F.col("hi_center"))
                                < F.abs(F.col("ratio") - F.col("lo_center"))))
        cur = (assigned.groupBy("domain")
               .agg(F.coalesce(F.avg(F.when(~F.col("is_content"), F.col("ratio"))), F.first("lo_center")).alias("lo_center"),
                    F.coalesce(F.avg(F.when(F.col("is_content"), F.col("ratio"))), F.first("hi_center")).alias("hi_center")))
    return assigned.select("domain", "path", "ratio", "is_content").join(cur, "domain")


def extract_counts(model: DataFrame) -> DataFrame:
    """Times each path landed in the content cluster over the rounds."""
    return model.groupBy("domain", "path").agg(
        F.sum(F.col("is_content").cast("int")).cast("long").alias("extract_count"))


def latest_content_paths(model: DataFrame) -> DataFrame:
    """Content path list of each domain (its last training round)."""
    last = model.groupBy("domain").agg(F.max("seq").alias("seq"))
    return model.join(last, ["domain", "seq"]).filter("is_content").select("domain", "path")
