"""Topic reports over a topic-term table.

All reports read ``topic_terms(topic, term, weight)`` (M13), whatever model
produced it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import SIMILAR_TOPICS, STOP_WORDS, TOP_TERMS_REPORT
from ..session import ensure_checkpoint_dir


def top_terms(topic_terms: DataFrame, n: int = TOP_TERMS_REPORT, topic: int | None = None,
              weight_col: str = "weight") -> DataFrame:
    """Top-``n`` terms per topic by weight (ties by term), with rank.
    Spark pushes the rank limit below the shuffle (WindowGroupLimit)."""
    t = topic_terms if topic is None else topic_terms.filter(F.col("topic") == topic)
    w = Window.partitionBy("topic").orderBy(F.col(weight_col).desc(), "term")
    return t.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def cloud_sizes(terms: DataFrame) -> DataFrame:
    """Keyword cloud size ``floor(floor(weight * 1000) / 2)``."""
    return terms.select("topic", "term", F.floor(F.floor(F.col("weight") * 1000) / 2).cast("long").alias("size"))


def _drop_stop(terms: DataFrame) -> DataFrame:
    return terms.filter(~F.trim("term").isin(STOP_WORDS)).withColumn("term", F.trim("term"))


def _ordered_terms(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]),
                     ", ").alias("terms"))


def topic_overlaps(topic_terms: DataFrame, query_words: DataFrame, n: int = TOP_TERMS_REPORT,
                   weight_col: str = "weight") -> DataFrame:
    """Topics whose top-``n`` terms (stop words removed first) meet a
    query-word group: ``(key, topic, terms)`` with the topic's terms in rank
    order.  All topics take part."""
    t = top_terms(_drop_stop(topic_terms), n, weight_col=weight_col)
    hit = t.join(query_words.select("key", F.col("word").alias("term")), "term") \
           .select("key", "topic").distinct()
    return _ordered_terms(t.join(hit, "topic"), ["key", "topic"])


def unique_query_terms(topic_terms: DataFrame, query_words: DataFrame, n: int = TOP_TERMS_REPORT,
                       weight_col: str = "weight") -> DataFrame:
    """Per query key, the distinct terms of all its overlapping topics."""
    t = top_terms(_drop_stop(topic_terms), n, weight_col=weight_col)
    hit = t.join(query_words.select("key", F.col("word").alias("term")), "term") \
           .select("key", "topic").distinct()
    return t.join(hit, "topic").groupBy("key").agg(
        F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("terms"))


def normalized_weights(topic_terms: DataFrame) -> DataFrame:
    """``weight / sum over topics of the term's weight`` (0 when the sum
    is 0), ranked per topic."""
    total = topic_terms.groupBy("term").agg(F.sum("weight").alias("_tot"))
    n = topic_terms.join(total, "term").withColumn(
        "norm_weight", F.when(F.col("_tot") == 0, F.lit(0.0)).otherwise(F.col("weight") / F.col("_tot")))
    # rank on the weight rounded to 12 digits: sums taken in a different order
    # may differ in the last bit, which must not reorder ties
    n = n.drop("_tot").withColumn("_order", -F.round("norm_weight", 12))
    return ranks_in_groups(n, "topic", ["_order", "term"]).drop("_order")


def ranks_in_groups(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rank`` of every row in its group, for few groups of any size: ranges of
    (group, order) are numbered on their own and shifted by the rows of the
    group in earlier ranges, so no task holds a group.  The ranges come from a
    sample and are checkpointed, so that numbers and shifts see the same ones;
    there are at most as many (group, range) pairs as groups and ranges."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
    ranged = rows.repartitionByRange(n, group, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n")).select(
        group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = Window.partitionBy("_range", group).orderBy(*order)
    return (ranged.withColumn("_own", F.row_number().over(own)).join(shifts, [group, "_range"])
            .withColumn("rank", (F.col("_own") + F.col("_shift")).cast("int")).drop("_own", "_shift", "_range"))


def normalized_overlaps(topic_terms: DataFrame, query_words: DataFrame, n: int = TOP_TERMS_REPORT):
    """I10 and I11 on the normalised weights."""
    nw = normalized_weights(topic_terms).drop("rank")
    return (topic_overlaps(nw, query_words, n, weight_col="norm_weight"),
            unique_query_terms(nw, query_words, n, weight_col="norm_weight"))


def topic_distances(topic_terms: DataFrame) -> DataFrame:
    """Euclidean distance between topics on their term-aligned weight
    vectors (a term missing from a topic counts 0):
    ``sqrt(|a|^2 + |b|^2 - 2 a.b)``.

    Every pair of topics is listed (the grid is bounded by the model's topic
    count); pairs without a shared term have a product of 0.  Products come
    from the join on shared terms, one triangle only.
    """
    sq = topic_terms.groupBy("topic").agg(F.sum(F.col("weight") * F.col("weight")).alias("nn"))
    a = topic_terms.select(F.col("topic").alias("topic_a"), "term", F.col("weight").alias("wa"))
    b = topic_terms.select(F.col("topic").alias("topic_b"), "term", F.col("weight").alias("wb"))
    dot = (a.join(b, "term").filter("topic_a <= topic_b").groupBy("topic_a", "topic_b")
           .agg(F.sum(F.col("wa") * F.col("wb")).alias("dot")))
    na = sq.select(F.col("topic").alias("topic_a"), F.col("nn").alias("na"))
    nb = sq.select(F.col("topic").alias("topic_b"), F.col("nn").alias("nb"))
    grid = na.join(nb, F.col("topic_a") <= F.col("topic_b")).join(dot, ["topic_a", "topic_b"], "left")
    d2 = F.greatest(F.col("na") + F.col("nb") - 2 * F.coalesce("dot", F.lit(0.0)), F.lit(0.0))
    half = grid.select("topic_a", "topic_b", F.sqrt(d2).alias("distance"))
    sides = F.when(F.col("topic_a") == F.col("topic_b"), F.array(F.struct("topic_a", "topic_b"))).otherwise(
        F.array(F.struct("topic_a", "topic_b"),
                F.struct(F.col("topic_b").alias("topic_a"), F.col("topic_a").alias("topic_b"))))
    return half.select(F.explode(sides).alias("p"), "distance").select("p.topic_a", "p.topic_b", "distance")


def similar_topics(distances: DataFrame, topic_terms: DataFrame, n: int = SIMILAR_TOPICS,
                   order: str = "asc", n_terms: int = TOP_TERMS_REPORT) -> DataFrame:
    """The ``n`` nearest topics of each topic (``order='desc'`` gives the
    most distant ones, as the original's reversed argsort did) with their
    first ``n_terms`` terms."""
    d = distances.filter(F.col("topic_a") != F.col("topic_b"))
    o = F.col("distance").asc() if order == "asc" else F.col("distance").desc()
    w = Window.partitionBy("topic_a").orderBy(o, "topic_b")
    best = d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    terms = _ordered_terms(top_terms(topic_terms, n_terms).withColumnRenamed("topic", "topic_b"), ["topic_b"])
    return best.join(terms, "topic_b", "left").select("topic_a", "rank", "topic_b", "distance", "terms")
