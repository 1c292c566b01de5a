"""URL, key and de-duplication operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import TRAIN_DOC_LIMIT
from ..functions.textcols import authority, domain_root
from ..session import ensure_checkpoint_dir


def netloc(df: DataFrame, url_col: str = "url") -> DataFrame:
    """B1: URL authority (user info, port and case kept)."""
    return df.withColumn("netloc", authority(F.col(url_col)))


def root_key(df: DataFrame, url_col: str = "url") -> DataFrame:
    """B2: ``scheme://netloc/`` key."""
    return df.withColumn("root", domain_root(F.col(url_col)))


def dense_ids(values: DataFrame, col: str, id_col: str, start: Column | int = 0) -> DataFrame:
    """Dense ids ``start + 1 ..`` in sorted order of ``col`` without a global
    single-partition window: range-partition by the value, number rows inside
    each range, and offset each range by the sizes of the ranges before it
    (one small row per partition).  The ranges come from a sample, so they are
    checkpointed: numbers and sizes always see the same ranges."""
    spark = values.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))
    ensure_checkpoint_dir(spark)
    ranged = (values.select(col).repartitionByRange(n, col).withColumn("_pid", F.spark_partition_id())
              .checkpoint())
    local = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(col)))
    sizes = ranged.groupBy("_pid").agg(F.count("*").alias("_n"))
    offs = sizes.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    start_col = start if isinstance(start, Column) else F.lit(start)
    return (local.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
            .select(col, (start_col + F.col("_off") + F.col("_rn")).cast("long").alias(id_col)))


def get_or_create_keys(names: DataFrame, existing: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """Existing keys plus new keys for unseen names (sorted by name,
    numbered after the current maximum).  Fails when a name maps to more than
    one existing key."""
    dup = existing.groupBy(name_col).count().filter("count > 1").limit(1).count()
    if dup:
        raise ValueError(f"{name_col} maps to more than one {id_col}")
    new = names.select(name_col).distinct().join(existing.select(name_col), name_col, "left_anti")
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top")).scalar()
    fresh = dense_ids(new, name_col, id_col, start=top)
    return existing.select(id_col, name_col).unionByName(fresh.select(id_col, name_col))


def new_keys_only(names: DataFrame, existing: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """Only the rows created for unseen names (existing ones are skipped)."""
    return get_or_create_keys(names, existing, name_col, id_col).join(
        existing.select(name_col), name_col, "left_anti")


def unprocessed(articles: DataFrame, documents: DataFrame, url_col: str = "url") -> DataFrame:
    """Articles whose URL is not stored yet (in-batch repeats dropped)."""
    return articles.dropDuplicates([url_col]).join(documents.select(url_col), url_col, "left_anti")


def per_domain_counts(articles: DataFrame, domains: DataFrame) -> DataFrame:
    """Article count per domain; domains without any keep 0."""
    c = articles.groupBy("domain").agg(F.count("*").alias("n"))
    return domains.select("domain").distinct().join(c, "domain", "left") \
        .select("domain", F.coalesce("n", F.lit(0)).cast("long").alias("n_docs"))


def training_gate(counts: DataFrame, models: DataFrame | None = None,
                  limit: int = TRAIN_DOC_LIMIT) -> DataFrame:
    """Train when the domain has no model or fewer than ``limit`` docs."""
    c = counts
    if models is not None:
        c = c.join(models.select("domain").distinct().withColumn("has_model", F.lit(True)), "domain", "left")
    else:
        c = c.withColumn("has_model", F.lit(None).cast("boolean"))
    return c.select("domain", "n_docs",
                    (F.col("has_model").isNull() | (F.col("n_docs") < limit)).alias("train"))


def first_of_batch(articles: DataFrame, batch_cols=("domain",), order_col: str = "page_id",
                   max_pages: int = 1) -> DataFrame:
    """The first ``max_pages`` article(s) of each domain's batch."""
    w = Window.partitionBy(*batch_cols).orderBy(order_col)
    return articles.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_pages).drop("_r")
