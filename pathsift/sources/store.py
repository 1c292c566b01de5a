"""Stored tables and sinks.

Writes always go to a *new* path (or a partition overwrite of the rows being
written); a job never overwrites the path it is reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_extracts(records: DataFrame, path: str) -> None:
    """A3: append extract rows, partitioned by domain (pruned on read)."""
    records.write.mode("append").partitionBy("domain").parquet(path)


def keyed_update(base: DataFrame, updates: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """A4: update ``cols`` of rows whose key appears in ``updates``; keys only
    in ``updates`` are not added.  Returns the new snapshot (write it to a new
    path)."""
    u = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols])
    out = base.join(u, keys, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c))).drop(f"_new_{c}")
    return out


def sql(spark: SparkSession, query: str, views: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """A5: SQL over stored tables with named parameters (no string splicing)."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query, args=args or {})


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Save vocabulary, corpus or path-model tables as parquet."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ratio_log_lines(ratios: DataFrame) -> DataFrame:
    """Per-path ratio log lines ``path;--;ratio``."""
    return ratios.select("domain", F.concat("path", F.lit(";--;"),
                                            F.format_string("%.8f", F.col("ratio"))).alias("line"))


def append_ratio_log(ratios: DataFrame, path: str) -> None:
    ratio_log_lines(ratios).write.mode("append").partitionBy("domain").text(path)


def report_lines(overlaps: DataFrame) -> DataFrame:
    """A10: topic report lines ``key;topic;t1, t2, ...``."""
    return overlaps.select(F.concat_ws(";", "key", F.col("topic").cast("string"), "terms").alias("line"))


def write_report(overlaps: DataFrame, path: str, fmt: str = "csv") -> None:
    if fmt == "json":
        overlaps.write.mode("overwrite").json(path)
    else:
        report_lines(overlaps).write.mode("overwrite").text(path)


def summary_json(summary: DataFrame) -> DataFrame:
    """DOM summary rows as JSON documents."""
    return summary.select("domain", F.to_json(F.struct("dict_path", "values")).alias("json"))


def truncate(df: DataFrame, path: str) -> None:
    """Empty a table, keeping its schema."""
    df.limit(0).write.mode("overwrite").parquet(path)
