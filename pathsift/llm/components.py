"""Connected components by alternating large-star and small-star steps.

Labels are least members.  Links stay distributed; each step is written to
shared scratch storage, so a lost executor repeats at most one step.  A node
with very many links is a skewed join key, which adaptive execution splits;
its minimum is pre-aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u links to the least of u and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.filter("v > u").join(least, "u").filter("m <> v")
            .select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours link to the least of them (a < b)."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    return (edges.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
            .unionByName(least.select(F.col("m").alias("a"), "b")).distinct())


def connected(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (columns a, b); label is the
    least node of its component."""
    edges = common.saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                         .filter("a <> b").distinct(), "edges")
    while True:
        new = common.saved(_small_star(_large_star(edges)), "edges")
        # at rest, all edges lead from a least node to the others of its star
        roots = new.select(F.col("a").alias("n")).distinct()
        chained = new.join(roots, new["b"] == roots["n"], "left_semi").limit(1)
        multiple = new.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
        edges = new
        if not chained.count() and not multiple.count():
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
