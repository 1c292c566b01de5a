"""Registered queries for the feed group C (events in)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import keys
from ..session import ensure_checkpoint_dir
from ..sources import tables as tb
from ..streaming import feeds, ingest
from . import oracle_views as ov
from .registry import query

C1_SQL = f"""WITH {ov.FEED_POLLS},
p AS (
  SELECT *, last_value(CASE WHEN ok THEN coalesce(etag, '') END IGNORE NULLS) OVER (
    PARTITION BY feed_url ORDER BY poll_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM feed_polls),
s AS (
  SELECT *, CASE WHEN NOT ok THEN 'unchanged'
                 WHEN prev IS NULL OR coalesce(etag, '') <> prev THEN 'changed' ELSE 'same' END AS status
  FROM p)
SELECT feed_url, poll_ts, event_id, ok, etag, status, status = 'changed' AS changed,
       CASE WHEN status = 'changed' THEN coalesce(etag, '') ELSE prev END AS validator
FROM s"""


@query("c1_feed_changes", C1_SQL)
def c1_feed_changes(spark, sf):
    return feeds.feed_changes(tb.feed_polls(spark, sf))


@query("c3_changed_polls", f"""{C1_SQL.replace('FROM s', 'FROM s WHERE status = ' + "'changed'", 1)}""")
def c3_changed_polls(spark, sf):
    return feeds.changed_feeds(feeds.feed_changes(tb.feed_polls(spark, sf)))


@query("c4_dedupe_polls", f"""WITH {ov.FEED_POLLS}
SELECT DISTINCT ON (event_id) feed_url, poll_ts, event_id, ok, etag FROM feed_polls""")
def c4_dedupe_polls(spark, sf):
    return feeds.dedupe_polls(tb.feed_polls(spark, sf))


# ---------------------------------------------------- both validators, stream, ingest

CHANGES = f"""{ov.VALIDATED_POLLS},
v AS (
  SELECT *, CASE WHEN ok THEN coalesce('etag:' || nullif(etag, ''), 'modified:' || nullif(modified, ''), 'poll:' || event_id) END AS sent
  FROM validated_polls),
q AS (
  SELECT *, last_value(sent IGNORE NULLS) OVER (
    PARTITION BY feed_url ORDER BY poll_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM v),
changes AS (
  SELECT feed_url, poll_ts, event_id, ok, etag, modified,
         CASE WHEN NOT ok THEN 'unchanged' WHEN prev IS NULL OR sent <> prev THEN 'changed' ELSE 'same' END AS status,
         ok AND (prev IS NULL OR sent <> prev) AS changed,
         CASE WHEN ok AND (prev IS NULL OR sent <> prev) THEN sent ELSE prev END AS validator FROM q)"""


@query("c1_feed_validators", f"WITH {CHANGES} SELECT * FROM changes")
def c1_feed_validators(spark, sf):
    """Change detection by etag or Last-Modified, batch form."""
    return feeds.feed_changes(tb.validated_polls(spark, sf))


def _polls_dir(spark, sf) -> tuple[str, str]:
    """The polls as files of a stream, with an end mark; and a scratch folder."""
    work = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    polls = tb.validated_polls(spark, sf).select(*feeds.POLL_COLUMNS)
    polls.write.parquet(f"{work}/polls")
    last = polls.agg(F.date_format(F.max("poll_ts"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    if last:
        feeds.end_mark(spark, f"{work}/polls", last)
    return f"{work}/polls", work


@query("c1_stream_changes", f"WITH {CHANGES} SELECT * FROM changes")
def c1_stream_changes(spark, sf):
    """The same rows from the stream: event-time state, committed cycles."""
    source, work = _polls_dir(spark, sf)
    feeds.run_feed_stream(spark, source, f"{work}/store", f"{work}/checkpoint").awaitTermination()
    return feeds.CycleStore(spark, f"{work}/store", feeds.FEED_TABLES).table("changes")


@query("c3_ingest", f"""WITH {CHANGES},
entry AS (
  SELECT p.page_id, CASE WHEN (c.event_id + j) % 50 <> 0 THEN p.url END AS url
  FROM changes c, range(3) AS r(j), pages p
  WHERE c.changed AND p.page_id = (3 * c.event_id + j) % (SELECT count(*) FROM pages)),
link AS (SELECT *, {ov.URL_AUTH} AS domain FROM entry)
SELECT 'document' AS kind, min(page_id) AS page_id, url, domain FROM link
WHERE url IS NOT NULL AND domain <> '' GROUP BY url, domain
UNION ALL SELECT 'quarantine', page_id, url, NULL FROM link WHERE url IS NULL OR domain = ''""")
def c3_ingest(spark, sf):
    """Changed feeds through the whole ingest; what it stored and set aside."""
    source, work = _polls_dir(spark, sf)
    ingest.run_ingest_stream(
        spark, source, lambda changed: tb.feed_entries(spark, sf, changed).select("page_id", "url"),
        f"{work}/store", f"{work}/checkpoint", fetched=tb.table(spark, sf, "pages")).awaitTermination()
    store = ingest.open_store(spark, f"{work}/store")
    docs = store.table("documents").select(F.lit("document").alias("kind"), "page_id", "url", "domain")
    return docs.unionByName(store.table("quarantine").select(
        F.lit("quarantine").alias("kind"), "page_id", "url", F.lit(None).cast("string").alias("domain")))


@query("c4_repeated_polls", f"""WITH {ov.VALIDATED_POLLS},
done AS (SELECT event_id FROM validated_polls WHERE poll_ts < TIMESTAMP '2024-01-08')
SELECT feed_url, poll_ts, event_id, ok, etag, modified FROM validated_polls
WHERE event_id NOT IN (SELECT event_id FROM done)""")
def c4_repeated_polls(spark, sf):
    """Every poll arrives twice, and those of the first week are stored already."""
    polls = tb.validated_polls(spark, sf)
    done = polls.filter(F.col("poll_ts") < F.lit("2024-01-08").cast("timestamp"))
    return feeds.dedupe_polls(polls.unionByName(polls), done)


@query("b6_new_articles_per_domain", f"""WITH {CHANGES}, {ov.PAGES},
entry AS (
  SELECT DISTINCT p.page_id, p.domain FROM changes c, range(3) AS r(j), pg p
  WHERE c.changed AND p.page_id = (3 * c.event_id + j) % (SELECT count(*) FROM pages) AND (c.event_id + j) % 50 <> 0)
SELECT d.domain, CAST(count(e.page_id) AS BIGINT) AS n_docs
FROM (SELECT DISTINCT domain FROM pg) d LEFT JOIN entry e USING (domain) GROUP BY d.domain""")
def b6_new_articles_per_domain(spark, sf):
    """The articles that changed feeds list, by domain."""
    changed = feeds.changed_feeds(feeds.feed_changes(tb.validated_polls(spark, sf)))
    listed = tb.feed_entries(spark, sf, changed).filter("url IS NOT NULL").select("page_id").distinct()
    pages = tb.pages(spark, sf)
    return keys.per_domain_counts(pages.join(listed, "page_id").select("page_id", "domain"), pages)
