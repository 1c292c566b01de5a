"""The registered ``opN_*`` queries: each applies one operator with production
parameters to its whole table and derives the result columns.  ``QUERIES``
maps names to functions of (spark, sf_dir); ``ORACLE`` to DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import default_tokenizer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def twin(name: str, sql: str) -> None:
    ORACLE[name] = sql


@query
def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_packing import write_packed
    packed = write_packed(common.documents(spark, sf_dir), common.scratch_path(spark, "packed"), default_tokenizer())
    return packed.select("shard", "row", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "position_resets",
                         F.sha2("input_ids", 256).alias("ids_sha256"))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts
    return token_counts(common.documents(spark, sf_dir), common.scratch_path(spark, "token-cache"),
                        default_tokenizer(), limit=1024)


@query
def op9_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .length_buckets import length_batches, token_lengths
    return length_batches(token_lengths(common.documents(spark, sf_dir), default_tokenizer()))


@query
def op8_distribution_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .distribution_rules import judge
    return judge(common.documents(spark, sf_dir))


@query
def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_fm
    docs = common.documents(spark, sf_dir)
    return quality_fm.scores(docs, quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query
def op10_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import labelled, toxicity_crf
    docs = common.documents(spark, sf_dir)
    model = toxicity_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_crf.scores(docs, model).select(
        "doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "spans")


@query
def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxent_lm import lm_scores
    return lm_scores(common.documents(spark, sf_dir))


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import matches
    return matches(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import components
    return components(common.documents(spark, sf_dir))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import removals
    return removals(common.documents(spark, sf_dir))


@query
def op11_golomb_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .golomb_dedup import exact_groups
    return exact_groups(common.documents(spark, sf_dir))


twin("op11_golomb_dedup", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d""")


@query
def op12_k2treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .treap_search import build_index, search
    index = build_index(common.documents(spark, sf_dir), common.scratch_path(spark, "treap-index"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


twin("op12_k2treap_search", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT row_number() OVER () AS r, doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
t AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS len FROM w),
p AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf
      FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM w) GROUP BY r, doc_id, n, term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
s AS (SELECT q.item_id, p.r, p.doc_id,
             sum(floor(1000 * ln((2 * t.total + 2)::DOUBLE / (2 * f.df + 1)))::BIGINT
                 * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + (90 * p.n * t.total) // t.len))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN p USING (term) CROSS JOIN t GROUP BY q.item_id, p.r, p.doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score,
             row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 10""")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import repair
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


twin("op13_conversation_repair", r"""
WITH RECURSIVE bits AS (SELECT range AS b, range::BIGINT AS v, 0 AS k FROM range(256)
    UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS tab FROM bits WHERE k = 8),
c AS (SELECT coalesce(conv_id::VARCHAR, '') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':'
                     || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                 lambda acc, x: xor(acc >> 8, tab[(xor(acc, x) & 255) + 1])), 4294967295) % 20 AS kind
      FROM conversations, crc),
m AS (SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM c, range(2) AS r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM m),
f AS (SELECT *, rtrim(text, E' \t\n\x0b\x0c\r') AS shown, left(role, 1) AS i,
             lag(left(role, 1)) OVER (PARTITION BY key ORDER BY pos) AS h,
             row_number() OVER (PARTITION BY key, role, text ORDER BY pos) > 1 AS seen FROM n),
g AS (SELECT *, CASE WHEN shown = '' THEN 'b' WHEN seen THEN 'd' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'o' END AS fault,
             CASE WHEN i IN ('s', 'u', 'a') THEN i ELSE 'x' END AS letter FROM f),
ins(s, cost, audit, s2) AS (VALUES (0, 0, '', 0), (1, 0, '', 1), (2, 0, '', 2), (3, 0, '', 3), (0, 2, 'I', 2), (1, 2, 'I', 2),
    (2, 2, 'I', 3), (3, 2, 'I', 2), (0, 4, 'II', 3), (1, 4, 'II', 3), (2, 4, 'II', 2), (3, 4, 'II', 3)),
ops(s, letter, cost, audit, s2) AS (VALUES (0, 's', 0, 'K', 1), (0, 'u', 0, 'K', 2), (1, 'u', 0, 'K', 2), (2, 'a', 0, 'K', 3),
    (3, 'u', 0, 'K', 2), (0, '', 2, 'R', 2), (1, '', 2, 'R', 2), (2, '', 2, 'R', 3), (3, '', 2, 'R', 2)),
dp AS (SELECT key, 0::BIGINT AS pos, 0 AS s, 0::BIGINT AS cost, '' AS audit FROM (SELECT DISTINCT key FROM g)
    UNION ALL
    SELECT key, pos, s, b.cost, b.audit FROM (
        SELECT w.key, w.pos, w.s, min({'cost': w.cost, 'audit': w.audit}) AS b FROM (
            SELECT d.key, d.pos + 1 AS pos, o.s2 AS s, d.cost + j.cost + o.cost + CASE WHEN g.fault = 't' THEN 1 ELSE 0 END AS cost,
                   d.audit || j.audit || o.audit AS audit
            FROM dp d JOIN g ON g.key = d.key AND g.pos = d.pos + 1 JOIN ins j ON j.s = d.s JOIN ops o ON o.s = j.s2
            WHERE g.fault NOT IN ('b', 'd') AND o.letter IN ('', g.letter)
            UNION ALL
            SELECT d.key, d.pos + 1, j.s2, d.cost + j.cost + 3, d.audit || j.audit || 'D'
            FROM dp d JOIN g ON g.key = d.key AND g.pos = d.pos + 1 JOIN ins j ON j.s = d.s) w
        GROUP BY w.key, w.pos, w.s)),
best AS (SELECT d.key, min({'cost': d.cost + j.cost, 'audit': d.audit || j.audit}) AS b
         FROM dp d JOIN (SELECT key, max(pos) AS pos FROM g GROUP BY key) z ON z.key = d.key AND z.pos = d.pos
         JOIN ins j ON j.s = d.s AND j.s2 IN (0, 3) GROUP BY d.key),
step AS (SELECT key, k, b.audit[k] AS op, len(replace(b.audit[1:k], 'I', '')) AS pos,
                len(replace(b.audit[1:k], 'D', '')) AS nth FROM best, unnest(range(1, len(b.audit) + 1)) AS u(k)),
shown AS (SELECT step.key, step.k, step.op, step.nth, g.role, g.letter,
                 CASE WHEN step.op = 'I' THEN '' ELSE g.text END AS text
          FROM step LEFT JOIN g ON g.key = step.key AND g.pos = step.pos WHERE step.op <> 'D'),
head AS (SELECT key, bool_or(nth = 1 AND op = 'K' AND letter = 's') AS system FROM shown GROUP BY key),
sha AS (SELECT key, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN (nth % 2 = 1) <> system THEN 'user' ELSE 'assistant' END
                                      || ':' || text, E'\n' ORDER BY k)) AS sha FROM shown JOIN head USING (key) GROUP BY key),
fact AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                count(*) FILTER (h IS NOT NULL AND h || i NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY key)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
       coalesce(b.audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS key FROM conversations) o
LEFT JOIN fact USING (key) LEFT JOIN best USING (key) LEFT JOIN sha USING (key)""")
