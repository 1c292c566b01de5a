"""Operator 1, benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are reduced to their lower-cased letters and digits
(bytes from 0x80 count as letters).  An item of m bytes may match with
``e = rate * m`` edits.  A region with at most e edits shares at least
``m - q + 1 - q * e`` q-grams with the item, and their diagonals (position in the
text less position in the item) differ by at most e; so shared q-grams are
counted in diagonal bands that overlap by e, regions that reach the bound stay,
and a banded alignment of the item verifies each.  e is lowered where the
bound would fall under 1, so the filter loses no match within the budget.

Items of more than 1.5 pieces are cut into pieces of ``piece`` bytes every half
piece, each searched by itself; so any quote of 1.5 pieces holds a whole piece,
and texts that quote a part of an item are found.  ``item_start`` and
``item_stop`` place a piece in its item (:func:`covered` adds up the share of an
item that a text holds).  Pieces go to the executors in blocks of a bounded number of bytes, each block
against all documents; texts are searched where they are read, without a
shuffle.

Defined results: null or empty text matches nothing, as do items with fewer
than q letters and digits; repeated rows of either table give a row each; null
ids stay null; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64

PIECES = "item_id bigint, piece int, item_start int, item_total int, body binary"
OUT = ("doc_id bigint, item_id bigint, piece int, start int, stop int, edits int, item_bytes int, shared_grams int, "
       "item_start int, item_stop int, item_total int")

#: Cells of the tables of alignments made at once (a few bytes each).
CELLS = 1 << 18

_KEEP = np.zeros(256, dtype=bool)
_KEEP[128:] = _KEEP[48:58] = _KEEP[97:123] = True


@dataclass
class Settings:
    q: int = 8
    rate: float = 0.1
    piece: int = 100
    block_bytes: int = 1 << 20
    table_bits: int = 22


def normalised(col: pa.Array):
    """Kept bytes, their offsets per document, the lower-cased bytes and the
    positions there of the kept bytes."""
    data, offs = common.buffers(pc.utf8_lower(col.cast(pa.large_string()).fill_null("")))
    keep = _KEEP[data]
    src = np.flatnonzero(keep)
    return data[src], np.searchsorted(src, offs), data, offs, src


def _cut(cfg: Settings):
    schema = common.arrow_schema(PIECES)

    def run(batches):
        for b in common.bounded(batches):
            body, offs, *_ = normalised(b.column("text"))
            ids, piece, start, total, out = [], [], [], [], []
            for k, item in enumerate(b.column("item_id").to_pylist()):
                text = body[offs[k]:offs[k + 1]].tobytes()
                if 2 * len(text) <= 3 * cfg.piece:
                    spots = [(0, len(text))]
                else:                                       # the last piece ends with the item
                    last = len(text) - cfg.piece
                    spots = [(a, a + cfg.piece) for a in (*range(0, last, max(cfg.piece // 2, 1)), last)]
                for j, (a, b_) in enumerate(spots):
                    ids.append(item)
                    piece.append(j)
                    start.append(a)
                    total.append(len(text))
                    out.append(text[a:b_])
            yield common.arrow_batch(schema, item_id=ids, piece=piece, item_start=start, item_total=total, body=out)
    return run


def packed_grams(x: np.ndarray, q: int) -> np.ndarray:
    """All q-grams (q <= 8) of a byte array as integers, one per position."""
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    padded = np.concatenate([x, np.zeros(8, np.uint8)])
    out = np.empty(n, U64)
    for k in range(min(8, n)):
        part = out[k::8]
        part[:] = np.frombuffer(padded, dtype="<u8", count=len(part), offset=k)
    return out & U64((1 << (8 * q)) - 1) if q < 8 else out


class Index:
    """q-grams of a block of pieces and the lemma's bounds."""

    def __init__(self, rows: list, cfg: Settings):
        self.cfg = cfg
        q = cfg.q
        rows = [r for r in rows if len(r["body"]) >= q]
        self.items, self.pieces = [r["item_id"] for r in rows], [r["piece"] for r in rows]
        self.starts, self.totals = [r["item_start"] for r in rows], [r["item_total"] for r in rows]
        self.body = [bytes(r["body"]) for r in rows]
        self.m = np.array([len(x) for x in self.body], dtype=np.int64)
        self.text, self.at = np.frombuffer(b"".join(self.body), np.uint8), np.cumsum(self.m) - self.m
        self.budget = np.minimum((cfg.rate * self.m).astype(np.int64), (self.m - q) // q)
        self.bound = self.m - q + 1 - q * self.budget
        self.width = 1 << np.ceil(np.log2(np.maximum(self.budget + 1, 16))).astype(np.int64)
        grams, item, pos = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, x in enumerate(self.body):
            g = packed_grams(np.frombuffer(x, np.uint8), q)
            grams.append(g)
            item.append(np.full(len(g), k))
            pos.append(np.arange(len(g)))
        g = np.concatenate(grams)
        order = np.argsort(g, kind="stable")
        self.item, self.pos = np.concatenate(item)[order].astype(np.int32), np.concatenate(pos)[order].astype(np.int32)
        self.grams, self.first = np.unique(g[order], return_index=True)
        self.first = np.append(self.first, len(g))
        self.table = np.zeros(1 << cfg.table_bits, dtype=bool)
        self.table[self.slot(self.grams)] = True

    def slot(self, g):
        return ((g * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.cfg.table_bits)).astype(np.int64)

    def regions(self, x: np.ndarray, offs: np.ndarray):
        """(document, item, lowest diagonal of the band, shared q-grams) of every
        band that reaches its item's bound.  Diagonals count from the
        document's start."""
        none = (np.zeros(0, np.int64),) * 4
        g = packed_grams(x, self.cfg.q)
        if not len(g) or not len(self.grams):
            return none
        at = np.flatnonzero(self.table[self.slot(g)])
        k = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        hit = self.grams[k] == g[at]
        at, k = at[hit], k[hit]
        doc = common.doc_of(offs, at)
        inside = at + self.cfg.q <= offs[doc + 1]
        at, k, doc = at[inside], k[inside], doc[inside]
        times = self.first[k + 1] - self.first[k]
        total = int(times.sum())
        if not total:
            return none
        ref = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(total)
        item = self.item[ref].astype(np.int64)
        doc = np.repeat(doc, times)
        diag = np.repeat(at, times) - offs[doc] - self.pos[ref] + self.m[item]      # never negative
        band = diag // self.width[item]
        low = (diag - band * self.width[item] < self.budget[item]) & (band > 0)     # also the band below
        doc, item = np.concatenate([doc, doc[low]]), np.concatenate([item, item[low]])
        band = np.concatenate([band, band[low] - 1])
        span = int(band.max()) + 1
        key, count = np.unique((doc * len(self.m) + item) * span + band, return_counts=True)
        item = (key // span) % len(self.m)
        good = count >= self.bound[item]
        key, item, count = key[good], item[good], count[good]
        return key // span // len(self.m), item, (key % span) * self.width[item] - self.m[item], count


def _rows(body, first, m, text, lo, n, low, width, limit, trace: bool):
    """The rows of :func:`alignments`, all lanes a row at a time; a lane ends
    where its item does or where no path is left.  Without ``trace`` only the
    edits are right."""
    w, rows, top = int(width.max()), int(m.max()), int(limit.max()) + 1
    kind = np.int16 if w + top < 1 << 15 else np.int32      # costs stop at top
    ranks = np.arange(w, dtype=kind)
    spot = low[:, None] + np.arange(w + rows)               # text position, row 0's first diagonal in front
    chars = text[np.clip(lo[:, None] + spot, 0, len(text) - 1)]
    item = body[np.minimum(first[:, None] + np.arange(rows), len(body) - 1)]
    edge = np.where(spot >= n[:, None], top, 0).astype(kind)
    outside = np.where(ranks >= width[:, None], top, 0).astype(kind)
    cost = np.where((spot[:, :w] >= 0) & (spot[:, :w] <= n[:, None]), outside, top).astype(kind)
    origin = np.broadcast_to(ranks, cost.shape)
    lane, ends = np.arange(len(m)), set(m.tolist())
    edits, start, stop = (np.full(len(m), -1, dtype=np.int64) for _ in range(3))
    for k in range(rows):
        sub = cost + (chars[:, k:k + w] != item[:, k:k + 1])
        down = np.empty_like(cost)                          # the item's character is left out
        down[:, :-1], down[:, -1] = cost[:, 1:] + 1, top
        step = np.minimum(sub, down) - ranks
        run = np.minimum.accumulate(step, axis=1)           # text characters are put in
        if trace:
            came = np.where(sub <= down, origin, np.append(origin[:, 1:], origin[:, :1], axis=1))
            lead = np.maximum.accumulate(np.where(step == run, ranks, 0), axis=1)
            origin = np.take_along_axis(came, lead.astype(np.int64), axis=1)
        cost = np.minimum(run + ranks, top)
        np.maximum(cost, edge[:, k:k + w], out=cost)
        np.maximum(cost, outside, out=cost)
        if k % 4 != 3 and k + 1 not in ends:
            continue
        least = cost.min(axis=1)
        go = least <= limit
        if k + 1 in ends:
            at = np.flatnonzero(go & (m == k + 1))
            end = np.argmin(cost[at], axis=1)
            edits[lane[at]] = least[at]
            start[lane[at]] = low[at] + origin[at, end]
            stop[lane[at]] = low[at] + end + m[at]
            go &= m > k + 1
        if not go.any():
            break
        if not go.all():
            chars, item, edge, outside, cost, origin = (a[go] for a in (chars, item, edge, outside, cost, origin))
            lane, low, m, limit = lane[go], low[go], m[go], limit[go]
    return edits, start, stop


def alignments(body, first, m, text, lo, hi, low, high, limit):
    """Many banded alignments at once: fewest edits that turn an item,
    ``body[first:first + m]``, into a stretch of ``text[lo:hi]``, as (edits,
    start, stop), the leftmost best end; edits are -1 beyond ``limit``.

    All but the two texts are arrays with an entry per alignment.  Start and end
    in the text are free and count from ``lo``.  Paths stay on the diagonals
    (text position less item position) from ``low`` to ``high``, so a row has
    ``high - low + 1`` cells.  Where texts end or are empty no path goes on."""
    text, body = (x if len(x) else np.zeros(1, np.uint8) for x in (text, body))
    width, out = high - low + 1, np.full((3, len(m)), -1, dtype=np.int64)
    order = np.lexsort((m, width))
    cells = (width + m)[order]
    at = 0
    while at < len(order):
        size = np.arange(1, len(order) - at + 1) * np.maximum.accumulate(cells[at:])
        part = order[at:at + max(1, int(np.searchsorted(size, CELLS, side="right")))]
        at += len(part)
        for trace in (False, True):                         # most have no match: where they start is not asked
            out[:, part] = _rows(body, first[part], m[part], text, lo[part], (hi - lo)[part], low[part], width[part],
                                 limit[part], trace)
            part = part[out[0, part] >= 0]
            if not len(part):
                break
    return out


def banded_alignment(item: np.ndarray, text: np.ndarray, limit: int, low: int | None = None,
                     high: int | None = None) -> tuple[int, int, int] | None:
    """One of :func:`alignments`, or None beyond ``limit``; without ``low`` and
    ``high`` all diagonals count."""
    n, m = len(text), len(item)
    low, high = -m if low is None else low, n if high is None else high
    if not m:
        return (0, max(low, 0), max(low, 0)) if max(low, 0) <= min(high, n) else None
    found = alignments(item, *np.array([[0], [m]]), text, *np.array([[0], [n], [low], [high], [limit]]))[:, 0].tolist()
    return tuple(found) if found[0] >= 0 else None


def _best(index: Index, x: np.ndarray, offs: np.ndarray) -> dict:
    """Best match of every item in every document by the bands of
    :meth:`Index.regions`: (edits, start, stop, shared q-grams).  The counted
    diagonals are ``width + e``; a path strays e from them."""
    doc, item, low, shared = index.regions(x, offs)
    m, e = index.m[item], index.budget[item]
    high = low + index.width[item] + 2 * e
    low = low - e
    lo, hi = np.maximum(low, 0), np.minimum(offs[doc + 1] - offs[doc], high + m)
    left = hi > lo
    doc, item, low, high, lo, hi, m, e, shared = (a[left] for a in (doc, item, low, high, lo, hi, m, e, shared))
    first = offs[doc] + lo
    best: dict = {}

    def keep(k, edits, start, stop):
        key, found = (int(doc[k]), int(item[k])), (int(edits), int(start), int(stop))
        if best.get(key) is None or found < best[key][:3]:
            best[key] = (*found, int(shared[k]))

    rest = []
    for k, (a, b, i) in enumerate(zip(first.tolist(), (offs[doc] + hi).tolist(), item.tolist(), strict=True)):
        at = x[a:b].tobytes().find(index.body[i])
        if at >= 0:
            keep(k, 0, lo[k] + at, lo[k] + at + m[k])
        else:
            rest.append(k)
    # where an item is held without an edit, no other band has a better match
    r = np.array([k for k in rest if (doc[k], item[k]) not in best], dtype=np.int64)
    edits, start, stop = alignments(index.text, index.at[item[r]], m[r], x, first[r], offs[doc[r]] + hi[r],
                                    low[r] - lo[r], high[r] - lo[r], e[r])
    for k in np.flatnonzero(edits >= 0):
        keep(r[k], edits[k], lo[r[k]] + start[k], lo[r[k]] + stop[k])
    return best


def _search(index: Index):
    schema = common.arrow_schema(OUT)

    def run(batches):
        for b in common.bounded(batches):
            x, offs, data, raw, src = normalised(b.column("text"))
            ids = b.column("doc_id").to_pylist()
            best = _best(index, x, offs)
            if not best:
                continue
            lead = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
            rows = []
            for (d, i), (edits, s, e, n) in sorted(best.items()):
                p, r = src[offs[d] + s], src[offs[d] + max(e - 1, s)]
                rows.append((ids[d], index.items[i], index.pieces[i], int(lead[p] - lead[raw[d]]),
                             int(lead[r + 1] - lead[raw[d]]), edits, int(index.m[i]), n,
                             index.starts[i], index.starts[i] + int(index.m[i]), index.totals[i]))
            yield common.arrow_batch(schema, **{f.name: [r[k] for r in rows] for k, f in enumerate(schema)})
    return run


def matches(docs: DataFrame, benchmark: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """The best match of every benchmark piece in every document that holds it:
    ids, offsets in code points, edits and shared q-grams."""
    cfg = cfg or Settings()
    spark = docs.sparkSession
    common.arrow_rows(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.coalesce("text", F.lit("")).alias("text"))
    pieces = common.saved(items.mapInArrow(common.lean(_cut(cfg)), PIECES), "benchmark-pieces")
    total = pieces.agg(F.sum(F.octet_length("body"))).first()[0]
    blocks = common.n_partitions(total, cfg.block_bytes)
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "piece"), F.lit(blocks)))
    texts = common.id_and_text(docs)
    out = None
    for k in range(blocks):
        # a block holds about block_bytes; each piece is below twice the piece length
        index = Index(dealt.filter(F.col("block") == k).orderBy("item_id", "piece").collect(), cfg)
        found = texts.mapInArrow(common.lean(_search(index)), OUT)
        out = found if out is None else out.unionByName(found)
    return out


def covered(found: DataFrame) -> DataFrame:
    """``(doc_id, item_id, covered)``: the share of an item's kept bytes whose
    pieces a document holds (pieces of one item overlap; a byte counts once)."""
    spans = F.array_sort(F.collect_set(F.struct("item_start", "item_stop")))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(x["item_stop"] - F.greatest(x["item_start"], acc["to"]), F.lit(0))).alias("n"),
        F.greatest(acc["to"], x["item_stop"]).alias("to"))
    total = F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda acc: acc["n"])
    return found.groupBy("doc_id", "item_id", "item_total").agg(total.alias("n")).select(
        "doc_id", "item_id", (F.col("n") / F.col("item_total")).alias("covered"))
