"""Stored path models that grow by cycles.

A cycle parses its new pages once.  New rounds of a domain are scored against
the stored items of earlier rounds (texts with the rounds they occur in); only
text pairs that no earlier cycle compared are compared.  Ratios and splits of
earlier rounds stay as stored, so cycles give the tables that one batch run over
the same pages in the same order gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import TRAIN_DOC_LIMIT
from ..session import cores, num_partitions
from ..sources.cycles import Attempt, CycleStore
from . import dom, extract, paths

TEXT_ID = "struct<h:binary,n:int>"
MODEL_TABLES = {
    "nodes": "page_id long, domain string, title string, doctype string, node_seq int, abs_path string, tag_path string, "
             "pos_path array<int>, direct_text string, no_text boolean, failed boolean",
    "train_pages": "domain string, page_id long, seq int",
    "paths": "domain string, path string, first_seen int, tag_path string, idx_path array<int>",
    "items": "domain string, path string, seq int, item string",
    "distances": f"x {TEXT_ID}, y {TEXT_ID}, lev int",
    "ratios": "domain string, path string, seq int, n_items long, ratio double",
    "model": "domain string, seq int, path string, ratio double, is_content boolean, threshold double, "
             "lo_center double, hi_center double",
    "extracts": "page_id long, domain string, xpath string, content string, content_length int",
}


def parsed(pages_df: DataFrame) -> DataFrame:
    """Nodes and marks of ``(page_id, domain, html)``.  Small scans arrive as
    one or two splits and are spread over the cluster before they are parsed."""
    src = pages_df.select("page_id", "domain", "html")
    target = cores(src.sparkSession)
    n = num_partitions(src)
    if n is not None and n < target:
        src = src.repartition(target, "page_id")
    return dom.explode_nodes(src, modes=("direct",), marks=True)


def train_cycle(store: CycleStore, attempt: Attempt, nodes: DataFrame, pages: DataFrame,
                limit: int = TRAIN_DOC_LIMIT) -> None:
    """Rounds of the domains' new pages ``(page_id, domain)``: the pages go on
    where the stored rounds of their domain end, up to ``limit`` rounds."""
    def stored(name: str) -> DataFrame:
        return store.table(name, before=attempt.cycle).join(pages.select("domain").distinct(), "domain", "left_semi")

    done = stored("train_pages").groupBy("domain").agg(F.max("seq").alias("done"))
    order = Window.partitionBy("domain").orderBy("page_id")
    train = (pages.select("domain", "page_id").withColumn("seq", F.row_number().over(order)).filter(F.col("seq") <= limit)
             .join(done, "domain", "left").withColumn("seq", F.col("seq") + F.coalesce("done", F.lit(0)))
             .filter(F.col("seq") <= limit))
    train = attempt.put("train_pages", train)

    nodes_t = nodes.join(train.select("page_id", "seq"), "page_id")
    known = stored("paths")
    fresh = (dom.candidate_paths(nodes_t).withColumnRenamed("abs_path", "path")
             .join(known.select("domain", "path"), ["domain", "path"], "left_anti"))
    candidates = known.unionByName(attempt.put("paths", fresh))
    evals = candidates.join(train.select("domain", "seq"), "domain").filter(F.col("seq") >= F.col("first_seen"))
    items = attempt.put("items", dom.path_items(nodes_t, evals, keys=("domain", "seq")))

    history = stored("items").select("domain", "path", "seq", "item")
    bg = paths.background(items, history)
    have = store.table("distances", before=attempt.cycle)
    fresh = attempt.put("distances", paths.new_distances(bg, items, history, have))
    ratios = attempt.put("ratios", paths.ratios_from(bg, items, have.unionByName(fresh)))
    attempt.put("model", paths.content_paths(ratios))


def extract_cycle(store: CycleStore, attempt: Attempt, nodes: DataFrame, pages: DataFrame,
                  limit: int = TRAIN_DOC_LIMIT, keep_empty: bool = False) -> DataFrame:
    """Main extracts of the cycle's pages, with the stored models and the new ones."""
    def all_of(name: str) -> DataFrame:
        old = store.table(name, before=attempt.cycle).join(pages.select("domain").distinct(), "domain", "left_semi")
        return old.unionByName(store.spark.read.schema(store.schemas[name]).parquet(attempt.paths[name]))

    train, model = all_of("train_pages"), all_of("model")
    wanted = extract.page_model(pages, train, model, limit)
    items = extract.content_items(nodes.filter("node_seq >= 0"), wanted, model)
    return attempt.put("extracts", extract.longest_extract(items, keep_empty=keep_empty))


def content_cycle(store: CycleStore, attempt: Attempt, pages_df: DataFrame, limit: int = TRAIN_DOC_LIMIT,
                  keep_empty: bool = False) -> DataFrame:
    """Parse, train and extract the new pages ``(page_id, domain, html)`` of a
    cycle; returns their extracts."""
    nodes = attempt.put("nodes", parsed(pages_df))
    pages = pages_df.select("page_id", "domain")
    train_cycle(store, attempt, nodes.filter("node_seq >= 0"), pages, limit)
    return extract_cycle(store, attempt, nodes, pages, limit, keep_empty)
