"""Keyed tables with versions (A4): an update writes the hash buckets that hold
its keys, and a new version's manifest points at them and at the untouched
buckets of earlier versions.  Readers see a version whole or not at all, and
older versions stay readable."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, buckets map<string,string>"


class KeyedTable:
    """``schema``: DDL of the rows; ``key``: the column that updates go by."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, n_buckets: int = 32):
        self.spark, self.path, self.schema, self.key, self.n_buckets = spark, path.rstrip("/"), schema, key, n_buckets

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n_buckets)).cast("int")

    def versions(self) -> dict[int, dict[int, str]]:
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/versions/*").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return {}
            raise
        return {r.version: {int(b): p for b, p in (r.buckets or {}).items()} for r in rows if r.version is not None}

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the last one); of some ``buckets`` only."""
        known = self.versions()
        at = known[max(known) if version is None else version] if known else {}
        paths = sorted({f"{p}/bucket={b}" for b, p in at.items() if buckets is None or b in buckets})
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _write(self, rows: DataFrame) -> dict[int, str]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], self.schema).columns
        (rows.select(*columns).withColumn("bucket", self._bucket()).repartition("bucket")
             .write.partitionBy("bucket").parquet(folder))
        found = self.spark.read.schema(f"{self.schema}, bucket int").parquet(folder).select("bucket").distinct().collect()
        return {r.bucket: folder for r in found}

    def _publish(self, version: int, buckets: dict[int, str]) -> None:
        row = self.spark.createDataFrame([(version, {str(b): p for b, p in buckets.items()})], MANIFEST)
        row.coalesce(1).write.mode("errorifexists").json(f"{self.path}/versions/version={version}")

    def create(self, rows: DataFrame) -> None:
        self._publish(0, self._write(rows))

    def update(self, updates: DataFrame, columns: list[str], only_missing: bool = False) -> list[int]:
        """A new version in which rows whose key is in ``updates`` have its
        ``columns`` (``only_missing``: where the row has none).  Null values
        change nothing, keys without a row add none, of updates that share a
        key the least non-null value counts.  Returns the buckets written."""
        known = self.versions()
        version = max(known)
        per_key = updates.groupBy(self.key).agg(*[F.min(c).alias(f"_new_{c}") for c in columns])
        touched = [r.b for r in per_key.select(self._bucket().alias("b")).distinct().collect()]
        touched = sorted(set(touched) & set(known[version]))
        old = self.read(version, touched)
        merged = old.join(per_key, old[self.key].eqNullSafe(per_key[self.key]), "left").drop(per_key[self.key])
        for c in columns:
            pair = [c, f"_new_{c}"] if only_missing else [f"_new_{c}", c]
            merged = merged.withColumn(c, F.coalesce(*pair))
        written = self._write(merged) if touched else {}
        self._publish(version + 1, known[version] | written)
        return touched
