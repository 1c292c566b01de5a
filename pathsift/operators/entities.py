"""Entity operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import NO_ENTITIES, SPAN_ENTITY_LABELS, TOKEN_ENTITY_TAGS


def _strip_quotes(c):
    return F.trim(F.trim(c, F.lit('"')), F.lit("'"))


def merge_adjacent(tokens: DataFrame, keep_tags=TOKEN_ENTITY_TAGS) -> DataFrame:
    """gaps and islands -- consecutive kept tokens of a sentence form one
    phrase (``pos - row_number()`` is constant inside an island); quotes are
    stripped from every token.  ``(doc_id, sent, start, phrase)``."""
    t = tokens.filter(F.col("tag").isin(list(keep_tags)))
    w = Window.partitionBy("doc_id", "sent").orderBy("pos")
    t = t.withColumn("grp", F.col("pos") - F.row_number().over(w))
    g = t.groupBy("doc_id", "sent", "grp").agg(
        F.min("pos").alias("start"),
        F.sort_array(F.collect_list(F.struct("pos", _strip_quotes(F.col("token")).alias("tok")))).alias("parts"))
    return g.select("doc_id", "sent", F.col("start").cast("int"),
                    F.array_join(F.transform("parts", lambda p: p["tok"]), " ").alias("phrase"))


def entities_from_tokens(tokens: DataFrame) -> DataFrame:
    """distinct person/organisation phrases per document, comma-joined
    (sorted; '' for documents without any are not emitted)."""
    p = merge_adjacent(tokens)
    return p.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("phrase")), ",").alias("ner"))


def entities_from_spans(mentions: DataFrame, keep=SPAN_ENTITY_LABELS) -> DataFrame:
    """spans with a kept label, quotes stripped, distinct, comma-joined."""
    m = mentions.filter(F.col("label").isin(list(keep)))
    return m.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set(_strip_quotes(F.col("text")))), ",").alias("ner"))


HEAD = 3


def gazetteer_mentions(tokens: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """F8: dictionary tagging with ``gazetteer(phrase, label)``, phrases of any
    length; where matches nest, the longest wins.  ``(doc_id, sent, start, n,
    text, label)``.

    Tokens are gathered by sentence in one shuffle.  Each position probes the
    phrases once, by its first words (up to three), and a phrase that starts
    like that is compared as a whole with the sentence's words; so the work
    doesn't depend on the number of phrase lengths.  One window over the hits of
    a sentence drops those inside a longer one.  Words must be at consecutive
    positions; repeated phrases with other labels are hits of their own.
    """
    lines = (tokens.groupBy("doc_id", "sent")
             .agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("words")))
    at = F.col("i")
    # a position goes on with the next words, not with its whole sentence
    word = lambda k: F.col(f"w{k}")

    def head(k):
        """The ``k`` words from position ``i`` on, null where there are fewer or a gap."""
        there = F.coalesce(word(k - 1)["pos"] == word(0)["pos"] + k - 1, F.lit(False))
        return F.when(there, F.struct(F.lit(k).alias("k"), F.concat_ws(" ", *[word(j)["token"] for j in range(k)]).alias("head")))

    n = F.size("words")
    ahead = F.arrays_zip(*[F.slice("words", k + 1, n).alias(f"w{k}") for k in range(HEAD)])
    starts = (lines.select("doc_id", "sent", F.posexplode(ahead).alias("i", "w"))
              .select("doc_id", "sent", "i", *[F.col(f"w.w{k}").alias(f"w{k}") for k in range(HEAD)])
              .select("doc_id", "sent", "i", F.explode(F.array(*[head(k) for k in range(1, HEAD + 1)])).alias("h"))
              .filter(F.col("h").isNotNull()).select("doc_id", "sent", "i", "h.k", "h.head"))
    terms = F.split("phrase", " ")
    book = gazetteer.select("phrase", "label", terms.alias("terms"), F.size(terms).alias("n"),
                            F.least(F.size(terms), F.lit(HEAD)).alias("k"),
                            F.array_join(F.slice(terms, 1, HEAD), " ").alias("head")).distinct()
    found = starts.join(book, ["k", "head"]).join(lines, ["doc_id", "sent"])
    # no lambda: with one the join would copy the whole sentence for every phrase that starts in it
    part = F.slice("words", at + 1, F.col("n"))
    whole = (F.get("words", at + F.col("n") - 1)["pos"] == F.get("words", at)["pos"] + F.col("n") - 1) & \
        (part.getField("token") == F.col("terms"))
    hits = found.filter(whole).select("doc_id", "sent", F.get("words", at)["pos"].alias("start"), "n",
                                      F.col("phrase").alias("text"), "label")
    # by start, longer ones first; equal spans are peers, which don't cover each other
    span = 1 << 32
    order = F.col("start").cast("long") * span + (span - 1 - F.col("n"))
    before = Window.partitionBy("doc_id", "sent").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("_end", F.max(F.col("start") + F.col("n")).over(before))
    return hits.filter(F.col("_end").isNull() | (F.col("_end") < F.col("start") + F.col("n"))).drop("_end")


def cleanup_entity_string(df: DataFrame, col: str = "ner") -> DataFrame:
    """list-literal entity strings (``LIKE '%[%]'``): longer than 2 chars
    -> split on ',', strip ``"``, ``'``, ``[``, ``]`` from the ends (in that
    order), drop remaining quotes, distinct, re-join; else the placeholder."""
    sel = df.filter(F.col(col).like("%[%]"))
    parts = F.transform(F.split(F.col(col), ","), lambda x: F.regexp_replace(
        F.trim(F.trim(F.trim(F.trim(x, F.lit('"')), F.lit("'")), F.lit("[")), F.lit("]")), "['\"]", ""))
    joined = F.array_join(F.array_sort(F.array_distinct(parts)), ",")
    return sel.withColumn("ner_clean", F.when(F.length(col) > 2, joined).otherwise(F.lit(NO_ENTITIES)))


def parse_entity_list(df: DataFrame, col: str = "ner", variant: int = 1) -> DataFrame:
    """entity string -> list.  Variant 1 drops blanks and strips quotes;
    variant 2 is a plain split."""
    if variant == 1:
        v = F.transform(F.filter(F.split(F.col(col), ","), lambda x: x != ""), _strip_quotes)
    else:
        v = F.split(F.col(col), ",")
    return df.withColumn("ner_list", v)
