"""Operator 9, packing by optimal length buckets.

The global histogram of token counts (rounded up to a small multiple) is
gathered; dynamic programming over it picks the bucket widths with the least
total padding.  Inside each bucket, batches of ``token_budget // width``
documents form in the order of a shard and the id.  Rows are numbered inside
shards of bounded size, dealt by the rows' own numbers (so rows of one id, or
without one, spread too), and shifted by the shards' running counts: a bucket
with a third of all rows is numbered by many tasks and no batch but a bucket's
last is short.

Documents wider than the budget come in one more bucket, each a batch of its
own with its own width.

Defined results: null or empty text has 0 tokens and takes the width of the
first bucket; repeated rows and ties are numbered each; a null id stays null;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

LENGTHS = "doc_id bigint, n_tokens int"


def _lengths(path: str):
    schema = common.arrow_schema(LENGTHS)

    def run(batches):
        enc = encoder(path)
        for b in batches:
            yield common.arrow_batch(schema, doc_id=b.column("doc_id"),
                                     n_tokens=[enc.count(t.as_py()) for t in b.column("text")])
    return run


def token_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    common.arrow_rows(docs.sparkSession)
    return common.id_and_text(docs).mapInArrow(common.lean(_lengths(tokenizer)), LENGTHS)


def optimal_widths(widths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Bucket widths (a subset of ``widths``, ascending, the largest included)
    with the least total padding.

    The cost of one bucket over sorted lengths is Monge, so the best split
    moves monotonically and divide and conquer needs O(B U log U)."""
    u = len(widths)
    if u <= n_buckets:
        return [int(w) for w in widths]
    w = widths.astype(np.float64)
    n = np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
    best = w * n[1:]            # one bucket over widths[0..j]; the constant sum of lengths is left out
    back = [np.zeros(u, dtype=np.int64)]
    for _ in range(1, n_buckets):
        new, frm = np.full(u, np.inf), np.zeros(u, dtype=np.int64)
        new[0] = best[0]
        work = [(1, u - 1, 0, u - 2)]
        while work:
            lo, hi, a, b = work.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            k = np.arange(a, min(b, mid - 1) + 1)
            cost = best[k] + w[mid] * (n[mid + 1] - n[k + 1])
            i = int(np.argmin(cost))
            new[mid], frm[mid] = cost[i], k[i]
            work += [(lo, mid - 1, a, int(k[i])), (mid + 1, hi, int(k[i]), b)]
        best = new
        back.append(frm)
    out, j = [], u - 1
    for frm in reversed(back):
        out.append(int(widths[j]))
        if j == 0 or frm is back[0]:
            break
        j = int(frm[j])
    return sorted(set(out))


def length_batches(lengths: DataFrame, n_buckets: int = 16, token_budget: int = 65_536, multiple: int = 8,
                   shard_rows: int = 1024) -> DataFrame:
    """doc_id, n_tokens, bucket, width, batch, slot, padding of every row of
    ``lengths`` (doc_id, n_tokens)."""
    spark = lengths.sparkSession
    lengths = common.saved(lengths.withColumn("_row", F.monotonically_increasing_id()), "lengths")
    width = (F.greatest(F.ceil(F.col("n_tokens") / multiple), F.lit(1)) * multiple).cast("int")
    rows = lengths.withColumn("width", width)
    # at most token_budget / multiple rows: a proven bound for the driver
    hist = sorted((r["width"], r["n"]) for r in rows.filter(F.col("width") <= token_budget)
                  .groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect())
    at = np.array([h[0] for h in hist], dtype=np.int64)
    n = np.array([h[1] for h in hist], dtype=np.int64)
    bounds = optimal_widths(at, n, n_buckets) if len(at) else []
    held = [int(n[(at > lo) & (at <= hi)].sum()) for lo, hi in zip([0, *bounds], bounds)]
    wide = rows.filter(F.col("width") > token_budget).count()
    shards = [common.n_partitions(c, shard_rows) for c in [*held, wide]]
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<int>")
    bucket = F.size(F.filter(edges, lambda b: b < F.col("width"))).cast("int")
    rows = rows.withColumn("bucket", bucket)
    rows = (rows.withColumn("width", F.coalesce(F.get(edges, F.col("bucket")), F.col("width")))
            .withColumn("shard", F.pmod(F.xxhash64("_row"), F.element_at(
                F.array(*[F.lit(s) for s in shards]), F.col("bucket") + 1)).cast("int")))
    sizes = rows.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens", "_row")
    numbered = (rows.withColumn("k", F.row_number().over(inside) - 1).join(starts, ["bucket", "shard"])
                .withColumn("k", F.col("k") + F.col("start"))
                .withColumn("fit", F.greatest(F.floor(F.lit(token_budget) / F.col("width")), F.lit(1))))
    batches = numbered.select("doc_id", "n_tokens", "bucket", "width",
                              F.floor(F.col("k") / F.col("fit")).cast("bigint").alias("batch"),
                              (F.col("k") % F.col("fit")).cast("int").alias("slot"))
    return batches.withColumn("padding", (F.col("width") - F.col("n_tokens")).cast("int"))
