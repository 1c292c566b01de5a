"""Input tables and the derived views every operator group reads (FIXTURES §2).

Each view is a pure DataFrame derivation of the driver tables, so its work
grows with them.  The SQL twins used by the DuckDB oracle live in
``pathsift.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.textcols import authority, first_line_title
from ..shipping import code_digest, ship

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A1/A5 scan: one parquet table (column pruning and filters reach the scan).
    Executors get the package with the first scan, wherever the caller lives."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- pages (A1)

def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 page source: accepted pages with their domain (URL authority)."""
    p = table(spark, sf_dir, "pages")
    return (p.filter(F.col("html").isNotNull() & (F.trim("html") != ""))
             .select("page_id", "url", authority(F.col("url")).alias("domain"), "html"))


def rejected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 reject frame: pages whose markup is missing or blank."""
    p = table(spark, sf_dir, "pages")
    return p.filter(F.col("html").isNull() | (F.trim(F.coalesce("html", F.lit(""))) == "")) \
            .select("page_id", "url")


def crawl_order(pages_df: DataFrame, limit: int | None = None) -> DataFrame:
    """``(domain, page_id, seq)``: arrival order of pages inside each domain.

    With ``limit`` only the first ``limit`` pages per domain are kept; Spark then
    plans a WindowGroupLimit on both sides of the shuffle, so a domain holding a
    third of all pages still ships at most ``limit`` rows per map task.
    """
    w = Window.partitionBy("domain").orderBy("page_id")
    out = pages_df.select("domain", "page_id").withColumn("seq", F.row_number().over(w))
    if limit is not None:
        out = out.filter(F.col("seq") <= limit)
    return out


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``crawl(page_id, domain, seq, html)``."""
    p = pages(spark, sf_dir)
    return p.join(crawl_order(p), ["domain", "page_id"]).select("page_id", "domain", "seq", "html")


# --------------------------------------------------------- feed polls (C)

def feed_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``feed_polls``: each event is one poll of feed ``user_id``.

    A failed poll (``error``) has no validator; a successful one carries the
    validator ``$.k`` of its JSON properties.
    """
    e = table(spark, sf_dir, "events")
    ok = F.col("event_type") != F.lit("error")
    return e.select(
        F.col("user_id").alias("feed_url"),
        F.col("ts").alias("poll_ts"),
        "event_id",
        ok.alias("ok"),
        F.when(ok, F.get_json_object("props", "$.k")).alias("etag"),
    )


def validated_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``validated_polls``: polls of servers of four kinds (feed modulo 4):
    0 sends only a Last-Modified value (day ``$.k % 28 + 1``), 1 nothing,
    2 both validators, 3 only the etag ``$.k``."""
    p = feed_polls(spark, sf_dir)
    kind, k = F.col("feed_url") % 4, F.col("etag").cast("int")
    return (p.withColumn("modified", F.when(kind.isin(0, 2), F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))))
             .withColumn("etag", F.when(kind.isin(2, 3), F.col("etag"))))


def feed_entries(spark: SparkSession, sf_dir: str, polls: DataFrame) -> DataFrame:
    """View ``feed_entries(event_id, page_id, url, html)``: the three articles
    that each poll lists, pages ``(3 * event_id + j) % pages``; every fiftieth
    entry comes without a link."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    n = max(1, p.count())
    listed = polls.select("event_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")) \
        .withColumn("page_id", (3 * F.col("event_id") + F.col("j")) % n)
    return listed.join(p, "page_id").select(
        "event_id", "page_id", F.when((F.col("event_id") + F.col("j")) % 50 != 0, F.col("url")).alias("url"), "html")


# ----------------------------------------------------------- extracts (G, H, J)

EPOCH = "2024-01-01"


def extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``extracts``: one extract row per text line of each document.

    ``xpath = 'p[i]'``, length in UTF-8 bytes, ``main_topic = doc_id % 20``,
    title = first line, date = 2024-01-01 + ``doc_id % 30`` days, entities =
    sorted distinct capitalised words joined by commas ('' when none).
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    lines = d.select("doc_id", "source", first_line_title(F.col("text")).alias("title"),
                     F.posexplode(F.split("text", "\n")).alias("i", "content"))
    words = F.filter(F.split("content", " "), lambda w: w.rlike("^[A-Z][a-z]+$"))
    return lines.select(
        (F.col("doc_id") * F.lit(1000000) + F.col("i") + 1).alias("extract_id"),
        F.col("doc_id").alias("document_id"),
        F.col("source").alias("domain"),
        F.concat(F.lit("p["), (F.col("i") + 1).cast("string"), F.lit("]")).alias("xpath"),
        "content",
        F.octet_length("content").cast("int").alias("content_length"),
        (F.col("doc_id") % 20).cast("int").alias("main_topic"),
        "title",
        F.timestamp_add("DAY", (F.col("doc_id") % 30).cast("int"),
                        F.lit(EPOCH).cast("timestamp")).alias("extracted_at"),
        F.array_join(F.array_sort(F.array_distinct(words)), ",").alias("ner"),
    )


# ------------------------------------------------------------- tokens

def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``tokens(doc_id, sent, pos, token, tag)``: line = sentence, blank split.

    A token is tagged ``PERSON`` when it is a capitalised word, else ``O``.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    sents = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("sent", "line"))
    toks = sents.select("doc_id", "sent", F.posexplode(F.split("line", " ")).alias("pos", "token"))
    return toks.filter(F.col("token") != "").select(
        "doc_id", F.col("sent").cast("int"), F.col("pos").cast("int"), "token",
        F.when(F.col("token").rlike("^[A-Z][a-z]+$"), "PERSON").otherwise("O").alias("tag"))


# ----------------------------------------------------------- gazetteer

GAZETTEER_LABELS = ["PERSON", "ORG", "WORK_OF_ART", "PRODUCT", "GPE"]


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``gazetteer(phrase, label)`` derived from ``benchmark``.

    Phrases = all sentences and all clauses (up to a comma) of each passage,
    whole; label cycles over the four kept labels plus ``GPE``, which the span
    filter must drop.
    """
    b = table(spark, sf_dir, "benchmark")
    labels = F.array(*[F.lit(x) for x in GAZETTEER_LABELS])
    label = F.element_at(labels, (F.col("item_id") % len(GAZETTEER_LABELS)).cast("int") + 1)
    sentences = F.replace("text", F.lit(". "), F.lit(".\n"))
    units = F.array_union(F.split(sentences, "\n"), F.split(F.replace(sentences, F.lit(", "), F.lit(",\n")), "\n"))
    return b.select(F.explode(units).alias("phrase"), label.alias("label")).filter(F.col("phrase") != "").distinct()


# --------------------------------------------------------- topic terms (I)

def topic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View ``topic_terms(topic, term, weight)``: a deterministic stand-in for
    a topic model -- topic = rank of the document ``source``, term = cleaned
    token (H3-H5), weight = the term's share of the topic's tokens.

    The texts are tokenized once: their counts are written and everything else
    comes from them.  Queries over the same documents share the table.
    """
    from ..functions.textcols import token_rows
    from ..operators.keys import dense_ids
    docs = table(spark, sf_dir, "documents")
    c = stored_view(spark, "topic-terms", docs.select("source", "text"), "source string, term string, n long",
                    lambda d: token_rows(d, "text", ["source"]).groupBy("source", F.col("token").alias("term"))
                    .agg(F.count("*").alias("n")))
    tot = c.groupBy("source").agg(F.sum("n").alias("tot"))
    topics = dense_ids(tot.select("source"), "source", "topic", start=-1)
    return (c.join(tot, "source").join(topics, "source")
            .select(F.col("topic").cast("int"), "term", (F.col("n") / F.col("tot")).alias("weight")))


def stored_view(spark: SparkSession, name: str, source: DataFrame, schema: str, make) -> DataFrame:
    """A derived table that is written once for exactly these ``source`` rows
    and this code (named by digests of both) and read afterwards."""
    from ..session import ensure_checkpoint_dir
    from .cycles import CycleStore
    a, b = F.xxhash64(*source.columns), F.hash(*source.columns)
    key = source.agg(F.count("*"), F.bit_xor(a), F.sum(a.cast("decimal(38,0)")), F.sum(b.cast("long"))).first()
    store = CycleStore(spark, f"{ensure_checkpoint_dir(spark)}/views/{name}-{code_digest()}-{'-'.join(str(v) for v in key)}",
                       {name: schema})
    attempt = store.begin(0)
    if attempt is not None:
        attempt.put(name, make(source))
        attempt.commit()
    return store.table(name)


# Query-word groups (M15) are a parameter of the overlap reports; these
# groups use frequent cleaned tokens of the driver documents.
QUERY_WORDS = [("german", "der"), ("german", "und"), ("french", "que"), ("french", "des"),
               ("english", "ing"), ("english", "heti")]

# Entity-search keywords (the dashboard's search box), frequent capitalised words.
ENTITY_KEYWORDS = ["Eriner", "Der", "La", "That"]


def query_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERY_WORDS, "key string, word string")
