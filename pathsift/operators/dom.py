"""DOM operators: HTML rows -> structural node rows -> paths.

Only the explosion touches Python: one ``mapInPandas`` pass parses each page
once inside the task that already holds it (no shuffle of the markup).  Every
later step is a DataFrame operation on the node table.
"""

from __future__ import annotations

from typing import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import html_tree
from ..functions.constants import EMPTY, HTML4_SUMMARY_TAGS, HTML5_SUMMARY_TAGS

TEXT_MODES = ("direct", "child", "subtree")

NODE_FIELDS = [
    T.StructField("title", T.StringType()),
    T.StructField("doctype", T.StringType()),
    T.StructField("node_seq", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("cls", T.StringType()),
    T.StructField("eid", T.StringType()),
    T.StructField("abs_path", T.StringType()),
    T.StructField("tag_path", T.StringType()),
    T.StructField("pos_path", T.ArrayType(T.IntegerType())),
    T.StructField("chain", T.ArrayType(T.StringType())),
    T.StructField("in_body", T.BooleanType()),
    T.StructField("direct_text", T.StringType()),
    T.StructField("child_text", T.StringType()),
    T.StructField("subtree_text", T.StringType()),
    T.StructField("no_text", T.BooleanType()),
    T.StructField("failed", T.BooleanType()),
]

#: Rows of an Arrow batch that a parse task hands on at most.
SLICE_ROWS = 4096


def explode_nodes(pages_df: DataFrame, modes: Sequence[str] = ("direct",),
                  html_col: str = "html", marks: bool = False) -> DataFrame:
    """One row per structural element of every page.

    All input columns except the markup are carried through.  ``modes`` picks
    which text columns are filled (others stay null), so a job that only needs
    the ``direct`` text never materialises subtree text.  ``no_text`` tells an
    element without direct text from one whose text is the sentinel's word.
    With ``marks`` every page also has a row with ``node_seq`` -1, which
    carries its title and doctype and whether parsing ``failed``.
    """
    bad = set(modes) - set(TEXT_MODES)
    if bad:
        raise ValueError(f"unknown text modes {bad}")
    keep = [f for f in pages_df.schema.fields if f.name != html_col]
    schema = T.StructType(keep + NODE_FIELDS)
    keep_names = [f.name for f in keep]
    names = schema.fieldNames()
    want = tuple(modes)

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        rows = []
        for pdf in batches:
            for rec in pdf.itertuples(index=False):
                r = rec._asdict()
                title, doctype, nodes, failed = html_tree.parsed_page(r[html_col])
                base = [r[k] for k in keep_names]
                if marks:
                    rows.append(base + [title, doctype, -1] + [None] * (len(NODE_FIELDS) - 4) + [failed])
                for i, (apath, tpath, pos, chain, in_body, node) in enumerate(nodes):
                    cls = " ".join(node.attrs.get("class", "").split())
                    direct = html_tree.own_text(node) if "direct" in want else None
                    rows.append(base + [
                        title, doctype, i, node.tag, cls, node.attrs.get("id", ""),
                        apath, tpath, pos, chain, in_body,
                        (direct or EMPTY) if "direct" in want else None,
                        html_tree.child_text(node) if "child" in want else None,
                        html_tree.subtree_text(node) if "subtree" in want else None,
                        not direct if "direct" in want else None, False,
                    ])
                    if len(rows) >= SLICE_ROWS:      # a page of very many nodes is handed on in slices
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return pages_df.mapInPandas(run, schema)


# ------------------------------------------------------------------ D1

def doctype_check(pages_df: DataFrame) -> DataFrame:
    """First doctype; ``'html'`` selects the HTML5 summary tag set, any
    other doctype the HTML4 set, and a page without one is skipped."""
    dt = F.regexp_extract("html", r"(?i)<!doctype\s+([^>]*)>", 1)
    return (pages_df.select("page_id", "domain", F.trim(dt).alias("doctype"))
            .filter(F.col("doctype") != "")
            .select("page_id", "domain", "doctype",
                    F.when(F.col("doctype") == "html", "html5").otherwise("html4").alias("tag_set"),
                    F.when(F.col("doctype") == "html", F.size(F.array(*[F.lit(t) for t in HTML5_SUMMARY_TAGS])))
                    .otherwise(len(HTML4_SUMMARY_TAGS)).alias("n_tags")))


# ------------------------------------------------------------------ D2/D3

def page_paths(nodes: DataFrame) -> DataFrame:
    """Distinct structural absolute paths of each page."""
    return nodes.select("domain", "page_id", "abs_path").distinct()


def candidate_paths(nodes: DataFrame, seq_col: str = "seq") -> DataFrame:
    """D3: merged candidate paths per domain with the page where each first
    appeared, plus the parsed step form used for matching (D4)."""
    return (nodes.groupBy("domain", "abs_path")
            .agg(F.min(seq_col).alias("first_seen"), F.first("tag_path").alias("tag_path"))
            .withColumn("idx_path", path_indexes(F.col("abs_path"))))


def path_indexes(abs_path) -> "F.Column":
    """Per-step explicit index of an absolute path, 0 where the step has none."""
    steps = F.split(F.substring(abs_path, 2, 1 << 30), "/")
    return F.transform(steps, lambda s: F.coalesce(
        F.regexp_extract(s, r"\[(\d+)\]$", 1).try_cast("int"), F.lit(0)))


def path_tags(abs_path) -> "F.Column":
    return F.regexp_replace(abs_path, r"\[\d+\]", "")


# ------------------------------------------------------------------ D4

def match_condition(idx_col: str = "idx_path", pos_col: str = "pos_path"):
    """A path step without an index matches every same-tag sibling."""
    return F.forall(F.zip_with(F.col(idx_col), F.col(pos_col),
                               lambda i, p: (i == 0) | (i == p)), lambda b: b)


def select_by_path(nodes: DataFrame, paths: DataFrame, keys: Sequence[str] = ("domain",)) -> DataFrame:
    """Nodes hit by absolute paths.  ``paths`` needs ``keys``, ``abs_path``;
    equi-join on the index-free tag path, then the per-step index check."""
    p = paths.select(*keys, F.col("abs_path").alias("path"),
                     path_tags(F.col("abs_path")).alias("tag_path"),
                     path_indexes(F.col("abs_path")).alias("idx_path"))
    return nodes.join(p, list(keys) + ["tag_path"]).filter(match_condition()).drop("idx_path")


# ------------------------------------------------------------------ D8

def path_items(nodes: DataFrame, paths: DataFrame, keys: Sequence[str],
               text_col: str = "direct_text") -> DataFrame:
    """D4 + D5 + D8: distinct text items of each (keys..., path); a path that
    hits no node yields the single item ``'empty'``.

    ``paths`` carries ``keys`` (which must identify a page), ``path``,
    ``tag_path`` and ``idx_path``; ``nodes`` carries ``keys`` and the node
    columns.
    """
    k = list(keys)
    hit = (nodes.select(*k, "tag_path", "pos_path", F.col(text_col).alias("item"))
           .join(paths.select(*k, "path", "tag_path", "idx_path"), k + ["tag_path"])
           .filter(match_condition())
           .select(*k, "path", F.coalesce(F.nullif("item", F.lit("")), F.lit(EMPTY)).alias("item")))
    missing = (paths.select(*k, "path")
               .join(hit.select(*k, "path").distinct(), k + ["path"], "left_anti")
               .withColumn("item", F.lit(EMPTY)))
    return hit.unionByName(missing).distinct()


# ------------------------------------------------------------------ D10

def page_titles(nodes: DataFrame) -> DataFrame:
    """The title of every page; of pages without a structural element too
    where ``nodes`` holds their marks."""
    return nodes.groupBy("page_id").agg(F.first("title", ignorenulls=True).alias("title"))


# ------------------------------------------------------------------ D12/D13

def dom_summary(nodes: DataFrame, mode: str = "union") -> DataFrame:
    """Per domain, ``body/<structural ancestors>/<tag>`` -> distinct
    ``(class, id)`` pairs, for elements reached from ``body`` through
    structural parents only.  The element set follows the page's doctype;
    pages without one are skipped.

    ``mode='union'`` merges the pages of a domain; ``mode='last'`` keeps the
    summary of the domain's last page for each path, like a shallow merge.
    """
    html5 = F.array(*[F.lit(t) for t in HTML5_SUMMARY_TAGS])
    html4 = F.array(*[F.lit(t) for t in HTML4_SUMMARY_TAGS])
    tagset = F.when(F.col("doctype") == "html", html5).otherwise(html4)
    n = (nodes.filter(F.col("doctype").isNotNull() & F.col("in_body"))
         .withColumn("tagset", tagset)
         .filter(F.array_contains("tagset", F.col("tag")))
         .filter(F.forall("chain", lambda t: F.array_contains(F.col("tagset"), t)))
         .select("domain", "page_id",
                 F.concat_ws("/", F.lit("body"), F.array_join("chain", "/"), F.col("tag")).alias("dict_path"),
                 F.struct(F.col("cls").alias("class"), F.col("eid").alias("id")).alias("value")))
    n = n.withColumn("dict_path", F.regexp_replace("dict_path", "//+", "/"))
    if mode == "union":
        return n.groupBy("domain", "dict_path").agg(F.array_sort(F.collect_set("value")).alias("values"))
    if mode == "last":
        last_page = n.groupBy("domain").agg(F.max("page_id").alias("page_id"))
        return (n.join(last_page, ["domain", "page_id"])
                .groupBy("domain", "dict_path").agg(F.array_sort(F.collect_set("value")).alias("values")))
    raise ValueError(mode)


# ------------------------------------------------------------------ D14/D15

def _predicates(cls, eid):
    return F.concat(
        F.when(cls != "", F.concat(F.lit("[contains(@class, '"), cls, F.lit("')]"))).otherwise(""),
        F.when(eid != "", F.concat(F.lit("[contains(@id, '"), eid, F.lit("')]"))).otherwise(""))


def short_attribute_paths(summary: DataFrame) -> DataFrame:
    """For every summary path that has a structural descendant, one
    ``//*/tag[contains(@class,'c')][contains(@id,'i')]`` per stored value."""
    s = summary.select("domain", "dict_path", "values")
    steps = F.split("dict_path", "/")
    above = (summary.filter(F.size(steps) > 1)
             .select("domain", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps) - 1),
                                                     lambda n: F.array_join(F.slice(steps, 1, n), "/")))
                     .alias("dict_path")).distinct())
    parents = s.join(above, ["domain", "dict_path"], "left_semi")
    v = parents.select("domain", F.element_at(F.split("dict_path", "/"), -1).alias("tag"),
                       F.explode("values").alias("v"))
    return v.select("domain", F.concat(F.lit("//*/"), F.col("tag"),
                                       _predicates(F.col("v.class"), F.col("v.id"))).alias("xpath")).distinct()


def full_attribute_paths(summary: DataFrame) -> DataFrame:
    """``//*/body/a/b/tag`` + predicates in three variants (class+id, id
    only, none) for every summary path and stored value."""
    base = F.concat(F.lit("//*/"), F.col("dict_path"))
    v = summary.select("domain", base.alias("base"), F.explode("values").alias("v"))
    idp = F.when(F.col("v.id") != "", F.concat(F.lit("[contains(@id, '"), F.col("v.id"), F.lit("')]"))).otherwise("")
    return (v.select("domain", F.explode(F.array(
        F.struct(F.lit("class_id").alias("variant"),
                 F.concat("base", _predicates(F.col("v.class"), F.col("v.id"))).alias("xpath")),
        F.struct(F.lit("id").alias("variant"), F.concat("base", idp).alias("xpath")),
        F.struct(F.lit("none").alias("variant"), F.col("base").alias("xpath")))).alias("x"))
        .select("domain", "x.variant", "x.xpath").distinct())


# ------------------------------------------------------------------ D16

def select_by_attribute_path(nodes: DataFrame, xpaths: DataFrame) -> DataFrame:
    """Nodes hit by ``//*/[a/b/]tag[contains(@class,'c')][contains(@id,'i')]``
    paths: equi-join on (domain, tag), then the listed ancestor steps must end
    the node's ancestor chain and the class/id substring tests must hold."""
    steps = F.split(F.regexp_extract("xpath", r"^//\*/([^\[]*)", 1), "/")
    p = xpaths.select(
        "domain", "xpath",
        F.element_at(steps, -1).alias("tag"),
        F.slice(steps, 1, F.size(steps) - 1).alias("want_anc"),
        F.regexp_extract("xpath", r"\[contains\(@class, '([^']*)'\)\]", 1).alias("want_cls"),
        F.regexp_extract("xpath", r"\[contains\(@id, '([^']*)'\)\]", 1).alias("want_id"))
    anc = F.when(F.col("in_body"), F.concat(F.array(F.lit("html"), F.lit("body")), F.col("chain"))) \
           .otherwise(F.slice(F.split(F.col("tag_path"), "/"), 2, F.size(F.split(F.col("tag_path"), "/")) - 2))
    n_want = F.size("want_anc")
    suffix_ok = (n_want == 0) | ((F.size("_anc") >= n_want)
                                 & (F.slice("_anc", F.greatest(F.size("_anc") - n_want + 1, F.lit(1)), n_want)
                                    == F.col("want_anc")))
    return (nodes.withColumn("_anc", anc).join(p, ["domain", "tag"])
            .filter(suffix_ok & F.col("cls").contains(F.col("want_cls")) & F.col("eid").contains(F.col("want_id")))
            .drop("want_cls", "want_id", "want_anc", "_anc"))
