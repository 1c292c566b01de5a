"""J5 over an index: postings of three-character pieces.

Every row's text (lower case) is indexed by its distinct trigrams, partitioned
by a hash bucket of the trigram.  A keyword reads the buckets of its own
trigrams, rows that hold all of them are candidates, and the candidates' texts
are compared with the keyword.  Keywords of one or two characters have no
trigram and are compared with every text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_BUCKETS = 128
POSTINGS = "tri string, id long, bucket int"


def _bucket(tri) -> F.Column:
    return F.pmod(F.xxhash64(tri), F.lit(N_BUCKETS)).cast("int")


def trigrams(text) -> F.Column:
    """Distinct pieces of three code points."""
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))),
                                                       lambda i: F.substring(text, i, F.lit(3))))) \
            .otherwise(F.array().cast("array<string>"))


def build_index(rows: DataFrame, path: str, id_col: str, text_col: str) -> None:
    """Writes the postings of ``rows`` (one per id) to ``path``; null text has none."""
    text = rows.select(F.col(id_col).cast("long").alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("text"))
    (text.select("id", F.explode(trigrams(F.col("text"))).alias("tri")).withColumn("bucket", _bucket(F.col("tri")))
         .repartition("bucket").sortWithinPartitions("tri").write.partitionBy("bucket").parquet(path))


def search(rows: DataFrame, path: str, id_col: str, text_col: str, keywords: Sequence[str]) -> DataFrame:
    """``rows`` with a ``keyword`` column, a row for each keyword (quotes
    stripped, any case) that the text contains."""
    spark = rows.sparkSession
    words = sorted({k.strip('"').strip("'").lower() for k in keywords if k})
    found = None
    long = [w for w in words if len(w) >= 3]
    if long:
        asked = spark.createDataFrame([(w, w[i:i + 3]) for w in long for i in range(len(w) - 2)], "keyword string, tri string").distinct()
        need = asked.groupBy("keyword").agg(F.count("*").alias("need"))
        pieces = sorted({w[i:i + 3] for w in long for i in range(len(w) - 2)})
        buckets = [r.b for r in spark.createDataFrame([(p,) for p in pieces], "tri string").select(_bucket(F.col("tri")).alias("b")).distinct().collect()]
        postings = (spark.read.schema(POSTINGS).parquet(path)
                    .filter(F.col("bucket").isin(buckets) & F.col("tri").isin(pieces)))
        candidates = (postings.join(asked, "tri").groupBy("keyword", "id").agg(F.count("*").alias("n"))
                      .join(need, "keyword").filter("n = need").select("keyword", "id"))
        found = rows.join(candidates, rows[id_col] == candidates["id"]).drop("id")
    for w in (w for w in words if 0 < len(w) < 3):
        part = rows.withColumn("keyword", F.lit(w))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.withColumn("keyword", F.lit("")).limit(0)
    return found.filter(F.lower(F.coalesce(text_col, F.lit(""))).contains(F.col("keyword")))
