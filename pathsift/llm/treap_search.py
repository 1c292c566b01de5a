"""Operator 12, ranked lexical search over K2-treaps of the term-document grid.

Index.  Documents are cut into blocks as they are read, without a shuffle.  A
block is a grid: rows are its terms (the most frequent first, so that full cells
lie together), columns its documents by ascending id, values the impacts
``(10^9 * tf) div (1000 * tf + 8 * m)``.  The grid is cut into quarters down to
single points.  Cells that hold a point are kept, level by level: a four-bit
mask of the quarters in use, and how far the cell's maximum lies below its
parent's (in steps of 4096, rounded up, so a bound stays a bound).  Ranks in the
masks replace pointers; the points hold ``tf``, from which the exact impact
follows.  All terms of all documents are indexed, whatever is asked later.

Search.  All items go through a block at once.  A state is an item and a range
of documents with one cell for each of the item's terms: the cells on the paths
of its rows.  Weights times maxima bound every score in the range.  In each
round every item takes its best states, and their paths descend together into
both halves of the range; single documents have exact scores.  States that
can't reach the item's k-th score (or tie with it under a later id) go.  A task
keeps k rows an item over all its blocks; a two-step window merges the tasks.

Items are taken in blocks of ``pairs`` item terms, each against the whole index.
Terms are compared by 64-bit hashes (for 10,000 item terms against a vocabulary
of 10^9, one foreign match is expected once in two million runs).

Defined results: null or termless texts match nothing and aren't counted in N;
equal scores go by ascending id, null ids last; repeated documents each take a
rank; rows of one item id (null too) count as one item with all their terms;
items without a match and empty tables give no rows; extra columns are ignored;
texts of any length are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import U64

BLOCKS = ("total_docs bigint, total_terms bigint, height int, docs int, masks binary, drops binary, tfs binary, "
          "wide binary, vocab binary, rows binary, dfs binary, ids binary, nulls int, norms binary")
STATS = "docs bigint, terms bigint"
TERMS = "item_id bigint, term bigint"
FREQS = "term bigint, df bigint"
HITS = "item_id bigint, doc_id bigint, score bigint, part int"
TOP_IMPACT = 1_000_000
STEP = 4096
POP = np.array([bin(m).count("1") for m in range(16)], np.uint8)
#: Children before quarter q of mask m, by ``4 * m + q``; -1 where it is empty.
BEFORE = np.array([POP[m & (1 << q) - 1] if m >> q & 1 else -1 for m in range(16) for q in range(4)], np.int8)
TERM_BYTE = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    TERM_BYTE[_lo:_hi + 1] = True


@dataclass
class Settings:
    block_bytes: int = 8 << 20
    block_docs: int = 8192
    k: int = 10
    beam: int = 16                 # states an item opens in one round
    pairs: int = 1 << 16           # item terms in one pass over the index
    lanes: int = 1 << 14           # item terms (padded) that descend together


def term_ranges(data: np.ndarray, offs: np.ndarray):
    """Starts, ends and document of all maximal term matches."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = TERM_BYTE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    stop[:-1] &= ~inside[1:] | first[1:-1]
    s = np.flatnonzero(begin)
    return s, np.flatnonzero(stop) + 1, common.doc_of(offs, s)


def _count(schema):
    def run(batches):
        docs = terms = 0
        for b in common.bounded(batches):
            data, offs = common.buffers(b.column("text"))
            doc = term_ranges(data, offs)[2]
            terms += len(doc)
            docs += len(np.unique(doc))
        yield common.arrow_batch(schema, docs=[docs], terms=[terms])
    return run


# ------------------------------------------------------------ the index

def _spread(x: np.ndarray) -> np.ndarray:
    """Puts a zero bit above each of the low 32 bits."""
    x = x.astype(U64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << U64(shift))) & U64(keep)
    return x


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _steps(maxima: np.ndarray) -> np.ndarray:
    return -(-maxima // STEP)


def block_row(data, offs, ids, none, total_docs: int, total_terms: int) -> dict:
    """The columns of one block; ``none`` marks null ids."""
    s, e, doc = term_ranges(data, offs)
    order = np.lexsort((ids, none))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    col = place[doc]
    n = np.bincount(col, minlength=len(ids))
    norms = 100 - 90 + (90 * n * total_docs) // max(total_terms, 1)
    vocab, term = np.unique(common.range_hashes(data, s, e), return_inverse=True)
    cell, tf = np.unique(term * len(ids) + col, return_counts=True)
    term, col = cell // len(ids), cell % len(ids)
    dfs = np.bincount(term, minlength=len(vocab))
    rows = np.empty(len(vocab), np.int64)
    rows[np.argsort(-dfs, kind="stable")] = np.arange(len(vocab))
    height = max(1, int(max(len(vocab), len(ids)) - 1).bit_length())
    code = _spread(rows[term]) << U64(1) | _spread(col)
    by = np.argsort(code)
    code, tf, col = code[by], tf[by], col[by]
    masks, drops = [], []
    top = impacts(tf, norms[col])
    for level in range(height):                          # from the points up
        starts = np.flatnonzero(np.diff(code >> U64(2), prepend=U64(2 ** 63)))
        above = np.maximum.reduceat(top, starts)
        masks.append(np.bitwise_or.reduceat(U64(1) << (code & U64(3)), starts).astype(np.uint8))
        if level:                                        # points follow from tf
            drops.append((np.repeat(_steps(above), np.diff(starts, append=len(code))) - _steps(top)).astype(np.uint8))
        code, top = (code >> U64(2))[starts], above
    drops.append(np.array([_steps(top)[0]], np.uint8))
    nibbles = np.concatenate(masks[::-1])
    nibbles = np.append(nibbles, np.zeros(len(nibbles) % 2, np.uint8))
    wide = np.flatnonzero(tf >= 255)
    return {"total_docs": total_docs, "total_terms": total_terms, "height": height, "docs": len(ids),
            "masks": (nibbles[::2] | nibbles[1::2] << 4).tobytes(), "drops": np.concatenate(drops[::-1]).tobytes(),
            "tfs": np.minimum(tf, 255).astype(np.uint8).tobytes(),
            "wide": np.stack([wide, tf[wide]]).astype(np.int64).tobytes(),
            "vocab": vocab.tobytes(), "rows": rows.astype(np.int32).tobytes(), "dfs": dfs.astype(np.int32).tobytes(),
            "ids": ids[order].tobytes(), "nulls": int(none.sum()), "norms": norms.astype(np.int64).tobytes()}


def _blocks(schema, cfg: Settings, total_docs: int, total_terms: int):
    def run(batches):
        held, size, docs = [], 0, 0

        def flush():
            data = np.concatenate([h[0] for h in held])
            offs = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[1]) for h in held]))])
            row = block_row(data, offs, np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]),
                            total_docs, total_terms)
            return common.arrow_batch(schema, **{k: [v] for k, v in row.items()})

        for b in common.bounded(batches):
            data, offs = common.buffers(b.column("text"))
            has = np.unique(term_ranges(data, offs)[2])
            if not len(has):
                continue
            if docs and (size + len(data) > cfg.block_bytes or docs + b.num_rows > cfg.block_docs):
                yield flush()
                held, size, docs = [], 0, 0
            ids = b.column("doc_id")
            held.append((data, offs, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
            size, docs = size + len(data), docs + b.num_rows
        if docs:
            yield flush()
    return run


def build_index(docs: DataFrame, path: str, cfg: Settings | None = None) -> DataFrame:
    """Writes the index of ``(doc_id, text)`` to ``path`` and returns it."""
    cfg = cfg or Settings()
    spark = docs.sparkSession
    rows = common.id_and_text(docs)
    total = (rows.select("text").mapInArrow(_count(common.arrow_schema(STATS)), STATS)
             .agg(F.sum("docs").alias("n"), F.sum("terms").alias("l")).first())
    run = _blocks(common.arrow_schema(BLOCKS), cfg, total["n"] or 0, total["l"] or 0)
    rows.mapInArrow(run, BLOCKS).write.option("parquet.block.size", 32 << 20).parquet(path)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


# ------------------------------------------------------------ search

class Treap:
    """One block, decoded: masks, first children and maxima of every level."""

    def __init__(self, row: dict):
        packed = np.frombuffer(row["masks"], np.uint8)
        nibbles = np.stack([packed & 15, packed >> 4], axis=1).ravel()
        drops = np.frombuffer(row["drops"], np.uint8)
        self.height, self.docs = row["height"], row["docs"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.none = np.arange(self.docs) >= self.docs - row["nulls"]
        self.norms = np.frombuffer(row["norms"], np.int64)
        self.vocab, self.rows = np.frombuffer(row["vocab"], U64), np.frombuffer(row["rows"], np.int32)
        tf = np.frombuffer(row["tfs"], np.uint8).astype(np.int64)
        wide = np.frombuffer(row["wide"], np.int64).reshape(2, -1)
        tf[wide[0]] = wide[1]
        # every level ends with an empty cell, which -1 points at
        self.tf = np.append(tf, 0)
        self.masks, self.first, tops = [], [], drops[:1].astype(np.int16)
        self.tops = [self._most(tops)]
        at, cells, seen = 0, 1, 1
        for level in range(self.height):
            m = nibbles[at:at + cells]
            kids = POP[m]
            self.masks.append(np.append(m, np.uint8(0)))
            self.first.append(np.append(np.cumsum(kids, dtype=np.int32) - kids, np.int32(0)))
            at, cells = at + cells, int(kids.sum(dtype=np.int64))
            if level + 1 < self.height:
                tops = np.repeat(tops, kids) - drops[seen:seen + cells]
                self.tops.append(self._most(tops))
                seen += cells

    @staticmethod
    def _most(steps: np.ndarray) -> np.ndarray:
        return np.append(np.minimum(steps.astype(np.int32) * STEP, TOP_IMPACT), 0).astype(np.int32)

    def children(self, level: int, cell: np.ndarray, lower: np.ndarray):
        """Cells of the left and right quarters in the upper or lower half of
        each cell one level down, -1 if they hold no point."""
        slot = (self.masks[level][cell] << 2) + (lower << 1)
        first = self.first[level][cell]
        for right in (0, 1):
            before = BEFORE[slot + right]
            yield np.where(before < 0, -1, first + before)

    def bound(self, level: int, cell: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Most a cell's points reach; at the points the impact itself."""
        if level < self.height:
            return self.tops[level][cell]
        return impacts(self.tf[cell], self.norms[np.minimum(col, self.docs - 1)][:, None])


class Best:
    """The k best documents of every item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item = np.zeros(0, np.int64)
        self.score, self.id, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.least = np.zeros(items, np.int64)           # the k-th score, 0 while there are fewer
        self.last_id, self.last_none = np.zeros(items, np.int64), np.ones(items, bool)

    def add(self, item, score, ids, none):
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        ids, none = np.concatenate([self.id, ids]), np.concatenate([self.none, none])
        order = np.lexsort((ids, none, -score, item))
        rank = _rank(item[order])
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.item, self.score, self.id, self.none = item[order], score[order], ids[order], none[order]
        full = rank == self.k - 1
        at = self.item[full]
        self.least[at], self.last_id[at], self.last_none[at] = self.score[full], self.id[full], self.none[full]

    def open(self, item, bound, ids, none):
        """Whether a bound, with the first id of its range, can still enter."""
        tied = (none < self.last_none[item]) | (none == self.last_none[item]) & (ids < self.last_id[item])
        least = self.least[item]
        return (bound > least) | (bound == least) & (bound > 0) & tied


def _rank(sorted_keys: np.ndarray) -> np.ndarray:
    starts = np.flatnonzero(np.diff(sorted_keys, prepend=-1))
    return np.arange(len(sorted_keys)) - np.repeat(starts, np.diff(starts, append=len(sorted_keys)))


class Pool:
    """Lines of cells, appended; states hold line numbers, so that waiting
    states aren't copied from round to round."""

    def __init__(self, lines: np.ndarray):
        self.lines, self.used = lines, len(lines)

    def put(self, lines: np.ndarray) -> np.ndarray:
        to = self.used + len(lines)
        if to > len(self.lines):
            grown = np.empty((2 * to, self.lines.shape[1]), self.lines.dtype)
            grown[:self.used] = self.lines[:self.used]
            self.lines = grown
        self.lines[self.used:to] = lines
        at, self.used = np.arange(self.used, to), to
        return at

    def keep(self, at: np.ndarray) -> np.ndarray:
        """Drops all lines but ``at`` once those are few."""
        if self.used > 4096 and 4 * len(at) < self.used:
            self.lines, self.used = self.lines[at], len(at)
            return np.arange(len(at))
        return at


def descend(treap: Treap, items: np.ndarray, rows: np.ndarray, weights: np.ndarray, best: Best, beam: int) -> None:
    """Best-first over document ranges for ``items``; ``rows`` (-1: term not in
    the block) and ``weights`` have a line for each of them."""
    height = treap.height
    cells = np.where(rows >= 0, 0, -1).astype(np.int32)
    pool = Pool(cells)
    states = {"item": np.arange(len(items)), "level": np.zeros(len(items), np.int64), "col": np.zeros(len(items), np.int64),
              "line": np.arange(len(items)), "bound": np.einsum("ij,ij->i", treap.bound(0, cells, np.zeros(len(items), np.int64)), weights)}
    while len(states["item"]):
        item, level, col, bound = (states[k] for k in ("item", "level", "col", "bound"))
        first = np.minimum(col << (height - level), treap.docs - 1)
        order = np.flatnonzero(best.open(items[item], bound, treap.ids[first], treap.none[first]))
        order = order[np.lexsort((first[order], -bound[order], item[order]))]
        now = _rank(item[order]) < beam
        parts = [{k: v[order[~now]] for k, v in states.items()}]
        order = order[now]
        done, grow = order[level[order] == height], order[level[order] < height]
        best.add(items[item[done]], bound[done], treap.ids[col[done]], treap.none[col[done]])
        for lv in np.unique(level[grow]):
            at = grow[level[grow] == lv]
            mine = item[at]
            lower = (rows[mine] >> (height - 1 - lv) & 1).astype(np.uint8)
            cells, scale = pool.lines[states["line"][at]], weights[mine]
            for right, to in enumerate(treap.children(lv, cells, lower)):
                to_col = 2 * col[at] + right
                value = np.einsum("ij,ij->i", treap.bound(lv + 1, to, to_col), scale)
                some = np.flatnonzero((value > 0) & (to_col << (height - 1 - lv) < treap.docs))
                parts.append({"item": mine[some], "level": np.full(len(some), lv + 1), "col": to_col[some],
                              "line": pool.put(to[some]), "bound": value[some]})
        states = {k: np.concatenate([p[k] for p in parts]) for k in states}
        states["line"] = pool.keep(states["line"])


def _search(schema, cfg: Settings, ids: np.ndarray, none: np.ndarray, item: np.ndarray, term: np.ndarray, weight: np.ndarray):
    """``item``/``term``/``weight``: pairs by item number; ``ids`` of the items."""
    def run(batches):
        from pyspark import TaskContext
        best = Best(len(ids), cfg.k)
        for b in batches:
            for r in range(b.num_rows):
                treap = Treap(b.slice(r, 1).to_pylist()[0])
                at = np.searchsorted(treap.vocab, term)
                at[at == len(treap.vocab)] = 0
                here = np.flatnonzero(treap.vocab[at] == term)
                count = np.bincount(item[here], minlength=len(ids))
                line = np.flatnonzero(count)
                line = line[np.argsort(-count[line], kind="stable")]
                while len(line):                         # items with about as many terms descend together
                    wide = int(count[line[0]])
                    now, line = line[:max(1, cfg.lanes // wide)], line[max(1, cfg.lanes // wide):]
                    mine = here[np.isin(item[here], now)]
                    mine = mine[np.argsort(item[mine], kind="stable")]
                    number = np.sort(now)
                    spot = np.searchsorted(number, item[mine]), _rank(item[mine])
                    rows, weights = np.full((len(now), wide), -1, np.int32), np.zeros((len(now), wide), np.int64)
                    rows[spot], weights[spot] = treap.rows[at[mine]], weight[mine]
                    descend(treap, number, rows, weights, best, cfg.beam)
        part = TaskContext.get().partitionId() % 64
        yield common.arrow_batch(schema, item_id=pa.array(ids[best.item], pa.int64(), mask=none[best.item]),
                                 doc_id=pa.array(best.id, pa.int64(), mask=best.none), score=best.score,
                                 part=np.full(len(best.item), part, np.int32))
    return run


def _item_terms(schema):
    def run(batches):
        for b in common.bounded(batches):
            data, offs = common.buffers(b.column("text"))
            s, e, doc = term_ranges(data, offs)
            yield common.arrow_batch(schema, item_id=b.column("doc_id").take(pa.array(doc)),
                                     term=common.range_hashes(data, s, e).view(np.int64))
    return run


def _frequencies(schema, terms: np.ndarray):
    def run(batches):
        df = np.zeros(len(terms), np.int64)
        for b in batches:
            for vocab, dfs in zip(b.column("vocab").to_pylist(), b.column("dfs").to_pylist(), strict=True):
                vocab, dfs = np.frombuffer(vocab, U64), np.frombuffer(dfs, np.int32)
                at = np.searchsorted(vocab, terms)
                at[at == len(vocab)] = 0
                df += np.where(vocab[at] == terms, dfs[at], 0)
        some = df > 0
        yield common.arrow_batch(schema, term=terms[some].view(np.int64), df=df[some])
    return run


def weight_of(total_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total_docs + 2) / (2 * df + 1)))


def search(index: DataFrame, items: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` of the ``k`` best documents an item."""
    cfg = cfg or Settings()
    spark = index.sparkSession
    text = common.id_and_text(items, "item_id")
    pairs = common.saved(text.mapInArrow(_item_terms(common.arrow_schema(TERMS)), TERMS).distinct(), "search-terms")
    total = index.select("total_docs").first()
    turns = common.n_partitions(pairs.count(), cfg.pairs)
    found = None
    for turn in range(turns if total else 0):
        mine = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == turn).toArrow()   # about cfg.pairs rows
        if not mine.num_rows:
            continue
        names = mine["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        item, term = names.indices.to_numpy().astype(np.int64), mine["term"].to_numpy().view(U64)
        known = names.dictionary
        terms = np.unique(term)
        run = _frequencies(common.arrow_schema(FREQS), terms)
        freq = index.select("vocab", "dfs").mapInArrow(run, FREQS).groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        weights = np.zeros(len(terms), np.int64)
        at = np.searchsorted(terms, freq["term"].to_numpy().view(U64))
        weights[at] = [weight_of(total[0], d) for d in freq["df"].to_pylist()]
        weight = weights[np.searchsorted(terms, term)]
        run = _search(common.arrow_schema(HITS), cfg, known.fill_null(0).to_numpy(),
                      known.is_null().to_numpy(zero_copy_only=False), item, term, weight)
        hits = index.mapInArrow(run, HITS)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item_id", "part"], ["item_id"]):      # hits of 64 groups of tasks first
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= cfg.k)
    return found.select("item_id", "rank", "doc_id", "score")
