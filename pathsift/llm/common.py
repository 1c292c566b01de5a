"""Shared helpers: scratch tables on shared storage and vectorised text hashing.

All hashing works on the raw UTF-8 buffers of Arrow string columns, a whole
batch of documents at a time, so per-word Python objects are never built.
"""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Documents per Arrow batch handed to a Python worker (a few MB of text).
BATCH_ROWS = 256


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared ``spark.checkpoint.dir``.

    Only in a local session without that setting (tests) a temporary folder is
    used and recorded in the session; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to shared scratch storage and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    w = df.write
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the number of documents per Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Seconds between two times that a worker gives memory back.
GIVE_BACK_S = 0.25
_given_back = [0.0]


def give_back() -> None:
    """Returns to the system what this Python worker has freed.  Workers outlive
    their tasks and wait with all they ever held, two for each core where a
    stage has two Python steps; an executor's limit counts the idle ones too."""
    now = time.monotonic()
    if now - _given_back[0] < GIVE_BACK_S:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):       # not glibc: it has no such call
        pass
    _given_back[0] = time.monotonic()


def lean(run):
    """A function of ``mapInArrow`` that gives memory back at the end of its task."""
    def lean_run(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return lean_run


def lean_groups(run):
    """A function of ``applyInArrow`` that gives memory back after a group."""
    def lean_run(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()
    return lean_run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, null text as empty; extra columns
    (of whatever name) are dropped before anything can clash with them."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc_mod(col: str | Column, m: int) -> Column:
    """crc32 of the id written as text, modulo ``m`` (null id: null)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(m)


def n_partitions(total_units: int, per_partition: int, least: int = 1) -> int:
    return int(max(least, -(-int(total_units or 0) // per_partition)))


# ---------------------------------------------------------------- hashing

def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply-xorshift), elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_CI = _BYTE[_LOWER]
_POW: dict[str, np.ndarray] = {}

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "f" not in _POW or len(_POW["f"]) < n:
        size = max(1 << 20, 1 << (int(n) - 1).bit_length() if n > 1 else 1)
        for key, base in (("f", _BASE), ("i", _BASE_INV)):
            a = np.full(size, base, dtype=U64)
            a[0] = 1
            _POW[key] = np.multiply.accumulate(a)
    return _POW["f"], _POW["i"]


def prefix_sums(data: np.ndarray, ci: bool = True) -> np.ndarray:
    """Sums that hashes of byte ranges are differences of; ``ci`` folds A-Z to a-z."""
    fwd, _ = _powers(len(data) + 1)
    g = np.empty(len(data) + 1, dtype=U64)
    g[0] = 0
    np.cumsum((_BYTE_CI if ci else _BYTE)[data] * fwd[:len(data)], out=g[1:])
    return g


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ci: bool = True,
                 sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte ranges; ``ci`` folds A-Z to a-z.  ``sums``: the
    data's :func:`prefix_sums`, where several range sets are hashed."""
    _, inv = _powers(len(data) + 1)
    g = prefix_sums(data, ci) if sums is None else sums
    return mix64((g[ends] - g[starts]) * inv[starts] + (ends - starts).astype(U64))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, dtype=np.int64)[col.offset:col.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0]:o[-1]], o - o[0]


def bounded(batches, column: str = "text", budget: int = 4 << 20):
    """Slices of Arrow batches with at most ``budget`` bytes of text, one
    document at least, so that working memory doesn't follow the batch."""
    for b in batches:
        _, offs = buffers(b.column(column))
        at, n = 0, b.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + budget, side="right")) - 1)
            yield b.slice(at, to - at)
            at = to


def doc_of(offs: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Index of the document that holds each byte position."""
    return np.searchsorted(offs, pos, side="right") - 1


def word_ranges(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of all words ``[^\\x20\\x09-\\x0D]+``."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~WHITE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offs] = True
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    stop[:-1] &= ~inside[1:] | first[1:-1]
    s = np.flatnonzero(begin)
    return s, np.flatnonzero(stop) + 1, doc_of(offs, s)


def gram_hashes(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive items within one document, with the index of
    the first item."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[n - 1:])
    acc = np.zeros(len(at), U64)
    for k in range(n):
        acc = acc * U64(0xC2B2AE3D27D4EB4F) + h[at + k]
    return mix64(acc), at


def arrow_schema(spec: str) -> pa.Schema:
    """Arrow schema of a Spark DDL schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(T._parse_datatype_string(spec))


def arrow_batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for f, c in
         ((f, cols[f.name]) for f in schema)], schema=schema)
