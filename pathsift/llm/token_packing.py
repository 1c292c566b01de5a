"""Operator 3, packed token ids: best-fit decreasing with a segment tree.

Texts are encoded where they are read; only their ids (16 or 32 bit) move, to
shards of a bounded number of tokens dealt by a hash of the id.  Documents
longer than the sequence length are cut losslessly into pieces.  Inside a
shard, pieces in descending length go to the open row with the least
remaining capacity that still holds them; a segment tree over the capacities
finds that row in logarithmic time.  Every output row is one packed row of
the id matrix with its cumulative segment lengths and position resets.

Defined results: null or empty text is a segment of length 0 (nothing is
dropped); repeated rows are packed each; ties go by id and piece; a null id
stays null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

PIECES = "shard int, doc_id bigint, piece int, ids binary"
PACKED = ("shard int, row int, n_tokens int, doc_ids array<bigint>, pieces array<int>, cu_seqlens array<int>, "
          "position_resets array<int>, input_ids binary")


class CapacityTree:
    """Rows by remaining capacity; finds the least capacity that holds a size."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, left: int, row: int) -> None:
        self.rows[left].append(row)
        k = left + self.leaves
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (capacity, row) of the tightest row, or None."""
        count, k = self.count, size + self.leaves
        while not count[k]:
            while k & 1:        # a right child: climb
                k >>= 1
            if not k:
                return None
            k += 1              # the sibling to the right
        while k < self.leaves:
            k *= 2
            if not count[k]:
                k += 1
        left, at = k - self.leaves, k
        while at:
            count[at] -= 1
            at >>= 1
        return left, self.rows[left].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of item indexes; sizes must not exceed ``capacity``."""
    tree, rows = CapacityTree(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        if found is None:
            rows.append([i])
            tree.put(capacity - sizes[i], len(rows) - 1)
        else:
            left, row = found
            rows[row].append(i)
            tree.put(left - sizes[i], row)
    return rows


def _encode(path: str, seq_len: int, width: str):
    schema = common.arrow_schema(PIECES)

    def run(batches):
        enc = encoder(path)
        for b in batches:
            shard, doc, piece, ids = [], [], [], []
            for s, d, t in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "text")), strict=True):
                all_ids = np.asarray(enc.ids(t), dtype=width)
                for k in range(max(1, -(-len(all_ids) // seq_len))):
                    shard.append(s)
                    doc.append(d)
                    piece.append(k)
                    ids.append(all_ids[k * seq_len:(k + 1) * seq_len].tobytes())
            yield common.arrow_batch(schema, shard=shard, doc_id=doc, piece=piece, ids=ids)
    return run


def _pack(seq_len: int, width: str, pad_id: int):
    schema = common.arrow_schema(PACKED)
    item = np.dtype(width).itemsize

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        doc, piece = table.column("doc_id").to_pylist(), table.column("piece").to_pylist()
        ids = table.column("ids").to_pylist()
        shard = table.column("shard")[0].as_py()
        sizes = [len(x) // item for x in ids]
        rows = best_fit_decreasing(sizes, seq_len)
        cu, matrix = [], []
        for r in rows:
            cu.append([0, *np.cumsum([sizes[i] for i in r]).tolist()])
            body = b"".join(ids[i] for i in r)
            matrix.append(body + np.full(seq_len - cu[-1][-1], pad_id, dtype=width).tobytes())
        batch = common.arrow_batch(
            schema, shard=[shard] * len(rows), row=list(range(len(rows))), n_tokens=[c[-1] for c in cu],
            doc_ids=[[doc[i] for i in r] for r in rows], pieces=[[piece[i] for i in r] for r in rows],
            cu_seqlens=cu, position_resets=[c[:-1] for c in cu], input_ids=matrix)
        return pa.Table.from_batches([batch])
    return run


def packed_rows(docs: DataFrame, tokenizer: str, seq_len: int = 2048, pad_id: int = 0,
                shard_bytes: int = 4 << 20, width: str = "<u2") -> DataFrame:
    """One row per packed row.  ``input_ids`` is a little-endian row of
    ``seq_len`` ids (``width``: ``<u2`` for vocabularies under 65,536, else
    ``<u4``), padded behind ``n_tokens``."""
    spark = docs.sparkSession
    common.arrow_rows(spark)
    texts = common.id_and_text(docs)
    total = texts.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0]
    shards = common.n_partitions(total, shard_bytes)
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    pieces = dealt.mapInArrow(_encode(tokenizer, seq_len, width), PIECES)
    return pieces.groupBy("shard").applyInArrow(_pack(seq_len, width, pad_id), PACKED)


def write_packed(docs: DataFrame, path: str, tokenizer: str, **options) -> DataFrame:
    """Write the packed rows as parquet files and return the written table."""
    packed_rows(docs, tokenizer, **options).write.mode("errorifexists").parquet(path)
    return docs.sparkSession.read.schema(PACKED).parquet(path)


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """Position ids of a packed row: they restart with every segment."""
    n = np.diff(np.asarray(cu_seqlens))
    return np.arange(n.sum()) - np.repeat(np.asarray(cu_seqlens[:-1]), n)
