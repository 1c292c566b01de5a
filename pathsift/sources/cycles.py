"""Tables that grow by cycles, with all outputs of a cycle visible at once.

A cycle writes each of its tables below a folder of its own attempt and then
one manifest file that names these folders.  Readers see only what a manifest
names, so a cycle that dies half way leaves nothing behind for them, and one
that is asked for again after its manifest exists is done already.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "cycle long, tables map<string,string>"


class CycleStore:
    """``schemas``: DDL of each table; ``buckets``: tables that are partitioned
    by a hash bucket of a column, so that a keyed lookup reads its buckets only."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str],
                 buckets: dict[str, str] | None = None, n_buckets: int = 64):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas
        self.buckets, self.n_buckets = buckets or {}, n_buckets

    def manifests(self) -> list[tuple[int, dict[str, str]]]:
        """Committed cycles in order; a store without any has none."""
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests/*").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return sorted((r.cycle, r.tables) for r in rows if r.cycle is not None)

    def last_cycle(self) -> int | None:
        done = self.manifests()
        return done[-1][0] if done else None

    def bucket(self, name: str) -> F.Column:
        return F.pmod(F.xxhash64(self.buckets[name]), F.lit(self.n_buckets)).cast("int")

    def table(self, name: str, before: int | None = None, only: int | None = None, latest: bool = False) -> DataFrame:
        """Rows of all committed cycles (``before`` one, ``only`` one); of a
        snapshot table the ``latest`` cycle's rows."""
        found = [(c, t[name]) for c, t in self.manifests() if name in t
                 and (before is None or c < before) and (only is None or c == only)]
        schema = self.schemas[name] + (", bucket int" if name in self.buckets else "")
        if not found:
            return self.spark.createDataFrame([], schema)
        paths = [p for _, p in (found[-1:] if latest else found)]
        if name not in self.buckets:
            return self.spark.read.schema(schema).parquet(*paths)
        # partition columns come from each folder, so every cycle is a scan of its own
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(p) for p in paths])

    def begin(self, cycle: int) -> Attempt | None:
        """A new attempt at a cycle; None if it is committed."""
        if any(c == cycle for c, _ in self.manifests()):
            return None
        return Attempt(self, cycle)


class Attempt:
    """Writes of one cycle that nobody sees before :meth:`commit`."""

    def __init__(self, store: CycleStore, cycle: int):
        self.store, self.cycle, self.paths = store, cycle, {}
        self.folder = f"cycle={cycle}/run={uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a table of the cycle; returns it as written."""
        st = self.store
        path = f"{st.path}/{name}/{self.folder}"
        columns = [f.name for f in st.spark.createDataFrame([], st.schemas[name]).schema.fields]
        df = df.select(*columns)
        schema = st.schemas[name]
        if name in st.buckets:
            df.withColumn("bucket", st.bucket(name)).repartition("bucket").write.partitionBy("bucket").parquet(path)
            schema += ", bucket int"
        else:
            df.write.parquet(path)
        self.paths[name] = path
        return st.spark.read.schema(schema).parquet(path)

    def commit(self) -> None:
        st = self.store
        row = st.spark.createDataFrame([(self.cycle, self.paths)], MANIFEST)
        row.coalesce(1).write.mode("overwrite").json(f"{st.path}/manifests/cycle={self.cycle}")
