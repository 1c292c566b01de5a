"""Operator 8, quality rules by distribution divergence.

A document's histogram of character classes and its histogram over the most
common words of its language are compared with references by the
Jensen-Shannon distance (square root of the divergence in bits).  The
references are the same histograms over all documents: one per language that
holds ``reference_words`` words or, in a small table, ``min_share`` of all
words, and one of all texts together.

A label makes no reference of junk: the common words of a reference must hold
``min_coverage`` of its words, and only words that two different texts share
count for that (copies of one text are one text).  Random strings share
nothing; a language's common words hold some 40 % of it.  A text is left out of
the reference that it is held to.  A text without a reference of its own (null,
scarcer or refused language) takes the least distance over all references.  At
most ``languages`` labels, those with most words, have one (3 KB each), which
bounds what is sent to the driver and back.

A distance counts only where the document is long enough for its histogram, and
its limit is relaxed by the divergence that sampling alone gives to a text of
that length.

The fixed base rules (length, repeated word windows) stand beside it.

Defined results: null or empty text has zeros everywhere and fails the base
rule; repeated rows return a row each; a null id stays null; an empty table
returns no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import U64

OUT = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
       "n_repeat_words bigint, base_failed boolean, char_distance double, word_distance double, kept boolean")
PARTS = "lang string, kind int, item bigint, n bigint, lo bigint, hi bigint"

#: Character classes: 0 white space, 1 lower, 2 upper, 3 digit, 4 sentence
#: marks, 5 other ASCII marks, 6 control, 7 lead byte of a non-ASCII character.
CLASSES = 8
_CLASS = np.full(256, 7, dtype=np.int8)
_CLASS[:128] = 5
_CLASS[:32] = 6
_CLASS[127] = 6
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 4
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

POOLED = "*"


@dataclass
class Rules:
    """Parameters: limits of the two distances, minimum lengths, sampling slack."""

    min_words: int = 50
    repeat_percent: int = 50
    common_words: int = 200
    char_limit: float = 0.26
    word_limit: float = 0.30
    min_chars: int = 200
    min_word_tokens: int = 100
    slack: float = 0.8
    min_share: float = 0.001
    reference_words: int = 20_000
    min_coverage: float = 0.25
    languages: int = 1000
    cells: int = 1 << 17
    flush_words: int = 1 << 20


def _per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def _class_counts(data, offs) -> np.ndarray:
    cls = _CLASS[data]
    lead = (data & 0xC0) != 0x80
    return np.stack([_per_doc((cls == k) & lead, offs) for k in range(CLASSES)], axis=1)


def base_facts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counted facts of a batch of documents."""
    n = len(offs) - 1
    s, e, doc = common.word_ranges(data, offs)
    words = np.bincount(doc, minlength=n)
    lead = (data & 0xC0) != 0x80
    facts = {"n_words": words, "word_chars": _per_doc(lead & ~common.WHITE[data], offs),
             "n_symbols": _per_doc(_SYMBOL[data], offs)}
    # words in windows of three found twice or more
    h = common.range_hashes(data, s, e, ci=False)
    g, at = common.gram_hashes(h, doc, 3)
    key = common.mix64(g + doc[at].astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(h) + 3, dtype=bool)
    for k in range(3):
        hit[at[twice] + k] = True
    facts["n_repeat_words"] = np.bincount(doc[hit[:len(h)]], minlength=n)
    # lines with a word that equal an earlier line of the document
    if len(data):
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offs] = True
        first[1:] |= data == 10
        ls = np.flatnonzero(first[:-1])
        le = np.append(ls[1:], len(data))
        le = le - (data[le - 1] == 10)
        c = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(~common.WHITE[data], out=c[1:])
        full = c[le] > c[ls]
        ls, le = ls[full], le[full]
        ld = common.doc_of(offs, ls)
        lk = common.mix64(common.range_hashes(data, ls, le, ci=False) + ld.astype(U64) * U64(0x9E3779B97F4A7C15))
        _, one = np.unique(lk, return_index=True)
        facts["n_dup_lines"] = np.bincount(ld, minlength=n) - np.bincount(ld[one], minlength=n)
    else:
        facts["n_dup_lines"] = np.zeros(n, dtype=np.int64)
    facts["_doc"], facts["_data"] = doc, (s, e)
    return facts


def _count_parts(rules: Rules):
    schema = common.arrow_schema(PARTS)

    def flush(held):
        lang, kind, item, n, lo, hi = [], [], [], [], [], []
        for name, (classes, hashes, texts) in held.items():
            h, t = np.concatenate(hashes), np.concatenate(texts)
            order = np.argsort(h, kind="stable")
            h, t = h[order], t[order]
            first = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0) if len(h) else np.zeros(0, np.int64)
            lang += [name] * (len(first) + CLASSES)
            kind += [0] * CLASSES + [1] * len(first)
            item.append(np.concatenate([np.arange(CLASSES), h[first].view(np.int64)]))
            n.append(np.concatenate([classes, np.diff(np.append(first, len(h)))]).astype(np.int64))
            # the least and greatest text that holds a word differ where two different texts do
            none = np.zeros(CLASSES, np.int64)
            lo.append(np.concatenate([none, np.minimum.reduceat(t, first) if len(first) else none[:0]]))
            hi.append(np.concatenate([none, np.maximum.reduceat(t, first) if len(first) else none[:0]]))
        if lang:
            yield common.arrow_batch(schema, lang=lang, kind=np.array(kind, np.int32), item=np.concatenate(item),
                                     n=np.concatenate(n), lo=np.concatenate(lo), hi=np.concatenate(hi))

    def run(batches):
        held, words = {}, 0
        for b in common.bounded(batches):
            data, offs = common.buffers(b.column("text"))
            s, e, doc = common.word_ranges(data, offs)
            h, classes = common.range_hashes(data, s, e), _class_counts(data, offs)
            text = common.range_hashes(data, offs[:-1], offs[1:]).view(np.int64)
            langs = np.array([x if x is not None else "" for x in b.column("lang").to_pylist()], dtype=object)
            for name in set(langs):
                mine = langs == name
                at = held.setdefault(name, [np.zeros(CLASSES, np.int64), [], []])
                at[0] = at[0] + classes[mine].sum(axis=0)
                at[1].append(h[mine[doc]])
                at[2].append(text[doc[mine[doc]]])
            words += len(h)
            if words >= rules.flush_words:
                yield from flush(held)
                held, words = {}, 0
        yield from flush(held)
    return run


@dataclass
class Reference:
    """Class and common word counts (word hashes ascending) of ``total`` words."""

    classes: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    total: int


def references(docs: DataFrame, rules: Rules) -> dict[str, Reference]:
    """``=`` and language -> reference; ``POOLED`` holds all texts together.
    At most ``common_words`` rows of each of ``languages`` reach the driver."""
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    parts = (rows.mapInArrow(_count_parts(rules), PARTS).groupBy("lang", "kind", "item")
             .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    parts = common.saved(parts, "histograms")
    words = parts.filter("kind = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    total = words.agg(F.sum("total")).first()[0] or 0
    pooled = parts.groupBy("kind", "item").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    least = max(1, min(rules.min_share * total, rules.reference_words))
    named = (words.filter((F.col("total") >= least) & (F.col("lang") != "")).select("lang", "total")
             .orderBy(F.desc("total"), "lang").limit(rules.languages))
    sizes = {POOLED: total} | {f"={r['lang']}": r["total"] for r in named.collect()}
    mine = parts.join(F.broadcast(named.select("lang")), "lang", "left_semi")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "item"))
    cols = "lang", "item", "n", (F.col("lo") != F.col("hi")).alias("shared")
    top = [pooled.filter("kind = 1").orderBy(F.desc("n"), "item").limit(rules.common_words)
           .withColumn("lang", F.lit(POOLED)).select(*cols),
           mine.filter("kind = 1").withColumn("rank", rank).filter(F.col("rank") <= rules.common_words)
           .withColumn("lang", F.concat(F.lit("="), "lang")).select(*cols)]
    kinds = [pooled.filter("kind = 0").withColumn("lang", F.lit(POOLED)).select(*cols),
             mine.filter("kind = 0").withColumn("lang", F.concat(F.lit("="), "lang")).select(*cols)]
    classes = {k: np.zeros(CLASSES) for k in sizes}
    for r in (x for f in kinds for x in f.collect()):
        classes[r["lang"]][r["item"]] = r["n"]
    found = {k: [] for k in sizes}
    for r in (x for f in top for x in f.collect()):
        found[r["lang"]].append((r["item"], r["n"], r["shared"]))
    out = {}
    for k, rows in found.items():
        if k != POOLED and sum(n for _, n, shared in rows if shared) < rules.min_coverage * sizes[k]:
            continue
        item = np.array([r[0] for r in rows], dtype=np.int64).view(U64)
        order = np.argsort(item)
        out[k] = Reference(classes[k], item[order], np.array([r[1] for r in rows], dtype=float)[order], sizes[k])
    return out


def _half_terms(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Terms of the divergence in bits; zero where both shares are zero."""
    m = p + q
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(2 * p / m), 0.0)
        b = np.where(q > 0, q * np.log2(2 * q / m), 0.0)
    return (a + b) / 2


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of rows of shares."""
    return np.sqrt(np.maximum(_half_terms(p, q).sum(axis=-1), 0.0))


def _judge(refs, rules: Rules):
    schema = common.arrow_schema(OUT)
    names = sorted(refs)
    index = {k: i for i, k in enumerate(names)}
    totals = np.array([max(refs[k].total, 1) for k in names], dtype=float)
    class_n = np.stack([refs[k].classes for k in names])
    class_ref = class_n / np.maximum(class_n.sum(axis=1), 1)[:, None]
    salt = common.mix64(np.arange(1, len(names) + 1, dtype=U64))
    keys = np.concatenate([common.mix64(refs[k].words + salt[i]) for k, i in index.items()])
    counted = np.concatenate([refs[k].counts for k in names])
    order = np.argsort(keys)
    keys, counted = keys[order], counted[order]
    top_n = np.array([refs[k].counts.sum() for k in names])
    rest_ref = 1 - top_n / totals
    # the references that hold each word: of word i those from start[i] to start[i + 1]
    word = np.concatenate([refs[k].words for k in names])
    holder = np.repeat(np.arange(len(names)), [len(refs[k].words) for k in names])
    by_word = np.argsort(word, kind="stable")
    held_share = np.concatenate([refs[k].counts / max(refs[k].total, 1) for k in names])[by_word]
    holder = holder[by_word]
    vocabulary, start = np.unique(word[by_word], return_index=True)
    start = np.append(start, len(word))

    def least_distances(classes, doc, hashes, n_words):
        """The least distance of each document to any of the references."""
        n, m = len(classes), len(names)
        shares = classes / np.maximum(classes.sum(axis=1), 1)[:, None]
        char_d = js_distance(shares[:, None, :], class_ref[None]).min(axis=1)
        at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
        known = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), dtype=bool)
        cell, count = np.unique(doc[known] * max(len(vocabulary), 1) + at[known], return_counts=True)
        cd, cw = cell // max(len(vocabulary), 1), cell % max(len(vocabulary), 1)
        p = count / np.maximum(n_words, 1)[cd]
        times = start[cw + 1] - start[cw]
        entry = np.repeat(start[cw] - np.cumsum(times) + times, times) + np.arange(times.sum())
        to, p, q = np.repeat(cd, times) * m + holder[entry], np.repeat(p, times), held_share[entry]
        seen_p = np.bincount(to, weights=p, minlength=n * m).reshape(n, m)
        seen_q = np.bincount(to, weights=q, minlength=n * m).reshape(n, m)
        div = np.bincount(to, weights=_half_terms(p, q), minlength=n * m).reshape(n, m)
        div = div + _half_terms(np.maximum(1 - seen_p, 0), np.maximum(rest_ref, 0)[None])
        div += np.maximum(1 - rest_ref[None] - seen_q, 0) / 2
        return char_d, np.sqrt(np.maximum(div, 0)).min(axis=1)

    def run(batches):
        for b in common.bounded(batches):
            data, offs = common.buffers(b.column("text"))
            n = len(offs) - 1
            facts = base_facts(data, offs)
            doc, (s, e) = facts.pop("_doc"), facts.pop("_data")
            lang = np.array([index.get(f"={x}", -1) for x in b.column("lang").to_pylist()], dtype=np.int64)
            lonely = np.flatnonzero(lang < 0)
            lang[lonely] = index[POOLED]
            classes = _class_counts(data, offs)
            chars = classes.sum(axis=1)
            # a text is left out of its own language's reference (and of the pooled one)
            others = np.maximum(class_n[lang] - classes, 0)
            char_d = js_distance(classes / np.maximum(chars, 1)[:, None],
                                 others / np.maximum(others.sum(axis=1), 1)[:, None])
            # words: only cells that the document has, and the reference's remaining mass
            word_d = np.ones(n)
            if len(keys) and len(doc):
                hashes = common.range_hashes(data, s, e)
                k = common.mix64(hashes + salt[lang[doc]])
                at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                known = keys[at] == k
                cell, count = np.unique(doc[known] * len(keys) + at[known], return_counts=True)
                cd, cw = cell // len(keys), cell % len(keys)
                n_words = facts["n_words"]
                left = np.maximum(totals[lang] - n_words, 1)
                p = count / np.maximum(n_words, 1)[cd]
                q = np.maximum(counted[cw] - count, 0) / left[cd]
                known_words = np.bincount(cd, weights=count, minlength=n)
                seen_p, seen_q = known_words / np.maximum(n_words, 1), np.bincount(cd, weights=q, minlength=n)
                top = np.clip((top_n[lang] - known_words) / left, 0, 1)
                div = np.bincount(cd, weights=_half_terms(p, q), minlength=n)
                div += _half_terms(np.maximum(1 - seen_p, 0), 1 - top)
                div += np.maximum(top - seen_q, 0) / 2
                word_d = np.sqrt(np.maximum(div, 0))
                step = max(1, rules.cells // len(names))
                for part in (lonely[i:i + step] for i in range(0, len(lonely), step)):
                    place = np.full(n, -1, dtype=np.int64)
                    place[part] = np.arange(len(part))
                    mine = place[doc] >= 0
                    char_d[part], word_d[part] = least_distances(classes[part], place[doc[mine]], hashes[mine],
                                                                 facts["n_words"][part])
            with np.errstate(divide="ignore", invalid="ignore"):
                # n draws over k cells diverge from their own source by about k / (8 n ln 2)
                char_ok = (chars < rules.min_chars) | (
                    char_d ** 2 <= rules.char_limit ** 2 + rules.slack * CLASSES / (8 * np.log(2) * chars))
                word_ok = (facts["n_words"] < rules.min_word_tokens) | (
                    word_d ** 2 <= rules.word_limit ** 2
                    + rules.slack * rules.common_words / (8 * np.log(2) * facts["n_words"]))
            base = (facts["n_words"] < rules.min_words) | (
                100 * facts["n_repeat_words"] > rules.repeat_percent * facts["n_words"])
            yield common.arrow_batch(schema, doc_id=b.column("doc_id"), base_failed=base, char_distance=char_d,
                                     word_distance=word_d, kept=~base & char_ok & word_ok,
                                     **{c: facts[c].astype(np.int64) for c in facts})
    return run


def judge(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Facts, distances and verdict of every document (columns ``doc_id``,
    ``text``, ``lang``)."""
    rules = rules or Rules()
    common.arrow_rows(docs.sparkSession)
    refs = references(docs, rules)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(_judge(refs, rules), OUT)
