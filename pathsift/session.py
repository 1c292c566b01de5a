"""SparkSession construction and shared-storage helpers.

Library code never builds its own session; callers pass one in.  These helpers
exist for tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale.  AQE re-plans joins and coalesces small
# shuffle partitions at run time; skew-join splits hot join keys; Arrow speeds
# up the few pandas UDFs (HTML parsing, edit distance, online LDA E-step).
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Pages can be large; keep Arrow batches modest so one batch of HTML
    # fits comfortably in a Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "pathsift", extra: dict | None = None) -> SparkSession:
    """Local session for tests/bench.  On a cluster, use the cluster's session."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("PATHSIFT_DRIVER_MEMORY", "16g"))
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names shared storage and is left untouched; it is
    an error to leave it unset there.  In local mode a fresh scratch folder is
    created.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        cur = tempfile.mkdtemp(prefix="pathsift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", cur)
    spark.sparkContext.setCheckpointDir(cur)
    return cur


def cores(spark: SparkSession) -> int:
    """Default parallelism of the cluster (shuffle partitions when the
    session does not expose a SparkContext, e.g. Spark Connect)."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def num_partitions(df) -> int | None:
    try:
        return df.rdd.getNumPartitions()
    except Exception:
        return None


def default_parallelism(spark: SparkSession) -> int:
    """Partition count for CPU-heavy stages (edit distance, parsing)."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(shuffle, cores(spark) * 4)
