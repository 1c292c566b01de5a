"""Descriptive statistics of extract lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_PCTS = [0.25, 0.35, 0.50, 0.75, 0.95]
DOMAIN_PCTS = [0.10, 0.25, 0.35, 0.50, 0.75, 0.95]


def _describe(keys: list[str], pcts: list[float]):
    x = F.col("content_length").cast("double")
    p = F.percentile(x, F.array(*[F.lit(q) for q in pcts]))
    aggs = [F.count("content_length").cast("long").alias("count"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
            p.alias("_p")]
    names = [f"p{int(round(q * 100)):02d}" for q in pcts]
    return aggs, names


def path_length_stats(extracts: DataFrame, documents: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """G1: length statistics per (domain, path): count, mean, std, min,
    25/35/50/75/95 %, max.  ``documents`` (``document_id, domain``) restricts
    to the domain's documents like the ``IN (select ...)`` of the original.
    With ``asked`` (``domain, xpath``) only these, and one without rows gets the
    statistics of the one-element series ``[0]`` (count 1, std null)."""
    e = extracts.filter(F.col("content_length").isNotNull())
    if documents is not None:
        e = e.join(documents.select("document_id", "domain"), ["document_id", "domain"], "left_semi")
    aggs, names = _describe(["domain", "xpath"], PATH_PCTS)
    g = e.groupBy("domain", "xpath").agg(*aggs)
    if asked is not None:
        g = asked.select("domain", "xpath").distinct().join(g, ["domain", "xpath"], "left")
        none = F.col("count").isNull()
        zeros = F.array(*[F.lit(0.0)] * len(names))
        g = g.select("domain", "xpath", F.coalesce("count", F.lit(1).cast("long")).alias("count"),
                     *[F.when(none, F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in ("mean", "min", "max")], "std",
                     F.when(none, zeros).otherwise(F.col("_p")).alias("_p"))
    return g.select("domain", "xpath", "count", "mean", "std", "min",
                    *[F.col("_p")[i].alias(n) for i, n in enumerate(names)], "max")


def domain_length_stats(extracts: DataFrame, domains: DataFrame) -> DataFrame:
    """Per-domain form with the 10 % point; a domain without rows gets the
    statistics of the one-element series ``[0]`` (count 1, std null)."""
    e = extracts.filter(F.col("content_length").isNotNull())
    aggs, names = _describe(["domain"], DOMAIN_PCTS)
    g = e.groupBy("domain").agg(*aggs)
    out = domains.select("domain").distinct().join(g, "domain", "left")
    zero = F.col("count").isNull()
    cols = [F.when(zero, F.lit(1)).otherwise(F.col("count")).cast("long").alias("count")]
    for c in ["mean", "min"]:
        cols.append(F.when(zero, F.lit(0.0)).otherwise(F.col(c)).alias(c))
    cols.append(F.col("std"))
    cols += [F.when(zero, F.lit(0.0)).otherwise(F.col("_p")[i]).alias(n) for i, n in enumerate(names)]
    cols.append(F.when(zero, F.lit(0.0)).otherwise(F.col("max")).alias("max"))
    return out.select("domain", *cols)
