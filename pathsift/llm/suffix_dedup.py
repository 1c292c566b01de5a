"""Operator 6, suffix-array deduplication by a common-prefix-aware distributed
merge sort.

A byte goes when a ``length``-byte string that covers it also starts earlier
(smaller id, or earlier in the same document).

1. Anchors.  Of each window of ``length`` bytes, the ``gram``-byte string with the
   least hash is the anchor (leftmost on ties); equal windows have equal
   anchors at equal offsets.  Anchor hashes meet in buckets, and only those
   that occur twice or more go on.
2. Runs.  The suffixes that start at repeated anchors are sorted where their
   text is, and sent as front-coded runs (length of the common prefix with the
   predecessor, and the rest) with the bytes left of the anchor.  Copies with
   the same surroundings inside a run are settled at once: only the earliest
   travels, so a text that a third of the rows hold moves once per run.
3. Merge.  A loser tree combines the runs of a bucket; each player knows its
   common prefix with the last winner, so known prefixes are never compared
   again.  The result is the sorted suffix order with its common prefixes.
   For each offset of a window from its anchor, suffixes with a common prefix
   to the window's end and equal bytes to the left are equal windows; all but
   the earliest are repeats.
4. Repeated windows become spans per document and are cut out.

Documents are told apart by id and content hash: repeated rows are one
document and each return its row; different texts under one id rank by their
hash; null ids rank first.  Null, empty and short texts lose nothing; an empty
table gives no rows; extra columns are ignored (``cut_documents`` keeps them).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64

ANCHORS = "bucket int, docs binary, which binary, hashes binary, places binary"
PARTS = "shard int, docs binary, counts binary, places binary"
REPEATED = "doc_id bigint, digest bigint, places binary"
RUNS = "bucket int, docs binary, places binary, bounds binary, shared binary, rests binary, lefts binary, spans binary"
SPANS = "doc_id bigint, digest bigint, spans binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
NO_ID = -(1 << 63)


@dataclass
class Settings:
    length: int = 100
    gram: int = 32
    anchor_bucket: int = 24 << 20       # bytes of text per bucket of anchors
    merge_bucket: int = 50_000          # anchors per bucket of the merge
    flush_anchors: int = 400_000
    flush_bytes: int = 16 << 20
    filter_bits: int = 27

    @property
    def span(self):
        """Offsets of an anchor within a window: 0 to span - 1."""
        return self.length - self.gram + 1


def anchors(data: np.ndarray, offs: np.ndarray, cfg: Settings):
    """Documents, positions, hashes of the anchors, with the first and last
    window start that each serves; positions count in the batch."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    n = len(data) - cfg.length + 1
    if n <= 0:
        return none
    grams = np.arange(len(data) - cfg.gram + 1)
    h = common.range_hashes(data, grams, grams + cfg.gram, ci=False)
    key = (h & U64(0xFFFFFFFF00000000)) | grams.astype(U64)
    width = 1
    while width < cfg.span:                 # minima over windows by doubling
        step = min(width, cfg.span - width)
        key = np.minimum(key[:len(key) - step], key[step:])
        width += step
    best = (key[:n] & U64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(n)
    doc = common.doc_of(offs, starts) if len(offs) < 3 else np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:n]
    inside = starts + cfg.length <= offs[doc + 1]
    starts, best, doc = starts[inside], best[inside], doc[inside]
    if not len(starts):
        return none
    new = np.concatenate([[True], (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    at = best[first]
    return doc[first], at, h[at], starts[first], starts[last]


def _doc_keys(b) -> np.ndarray:
    """(id, content hash) of each row."""
    ids = b.column("doc_id").fill_null(NO_ID).to_numpy()
    return np.stack([ids, b.column("digest").to_numpy()], axis=1)


def _send_anchors(buckets: int, cfg: Settings):
    schema = common.arrow_schema(ANCHORS)

    def flush(held):
        docs, which, h, at = (np.concatenate(x) for x in zip(*held, strict=True))
        home = (h % U64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[order], np.arange(buckets + 1))
        for k in range(buckets):
            pick = order[cut[k]:cut[k + 1]]
            if len(pick):
                used, inv = np.unique(which[pick], return_inverse=True)
                yield common.arrow_batch(
                    schema, bucket=[k], docs=[docs[used].tobytes()], which=[inv.astype(np.int32).tobytes()],
                    hashes=[np.ascontiguousarray((h[pick] >> U64(24)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()],
                    places=[at[pick].astype(np.uint32).tobytes()])

    def run(batches):
        held, rows, total = [], 0, 0
        for b in common.bounded(batches, budget=2 << 20):
            data, offs = common.buffers(b.column("text"))
            doc, at, h, _, _ = anchors(data, offs, cfg)
            held.append((_doc_keys(b), rows + doc, h, at - offs[doc]))
            rows += b.num_rows
            total += len(doc)
            if total >= cfg.flush_anchors:
                yield from flush(held)
                held, rows, total = [], 0, 0
        if total:
            yield from flush(held)
    return run


def _repeated(shards: int):
    """Places of repeated anchors, packed by shard of their documents."""
    schema = common.arrow_schema(PARTS)

    def run(table: pa.Table) -> pa.Table:
        docs, hashes, places = [], [], []
        for d, w, h, p in zip(*(table.column(c).to_pylist() for c in ("docs", "which", "hashes", "places")), strict=True):
            wide = np.zeros((len(p) // 4, 8), np.uint8)
            wide[:, :5] = np.frombuffer(h, np.uint8).reshape(-1, 5)
            docs.append(np.frombuffer(d, np.int64).reshape(-1, 2)[np.frombuffer(w, np.int32)])
            hashes.append(wide.view(np.int64).ravel())
            places.append(np.frombuffer(p, np.uint32))
        docs, hashes, places = np.concatenate(docs), np.concatenate(hashes), np.concatenate(places)
        # repeated rows (same document and place) count once
        order = np.lexsort((places, docs[:, 1], docs[:, 0], hashes))
        docs, hashes, places = docs[order], hashes[order], places[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (places[1:] != places[:-1]) | (docs[1:] != docs[:-1]).any(axis=1)
        docs, hashes, places = docs[new], hashes[new], places[new]
        same = np.concatenate([[False], hashes[1:] == hashes[:-1], [False]])
        many = same[:-1] | same[1:]
        docs, places = docs[many], places[many]
        home = (common.mix64(docs[:, 0].astype(U64)) % U64(shards)).astype(np.int64)
        order = np.lexsort((places, docs[:, 1], docs[:, 0], home))
        docs, places, home = docs[order], places[order], home[order]
        cut = np.searchsorted(home, np.arange(shards + 1))
        out = [k for k in range(shards) if cut[k + 1] > cut[k]]
        packed = [_pack_places(docs[cut[k]:cut[k + 1]], places[cut[k]:cut[k + 1]]) for k in out]
        return pa.Table.from_batches([common.arrow_batch(
            schema, shard=out, docs=[x[0].tobytes() for x in packed], counts=[x[1].tobytes() for x in packed],
            places=[x[2].tobytes() for x in packed])])
    return run


def _pack_places(docs: np.ndarray, places: np.ndarray):
    """Distinct documents of sorted rows, how many places each has, the places."""
    first = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]).any(axis=1)]))
    return docs[first], np.diff(np.append(first, len(docs))).astype(np.uint32), places


def _by_document():
    schema = common.arrow_schema(REPEATED)

    def run(table: pa.Table) -> pa.Table:
        docs, places = [], []
        for d, c, p in zip(*(table.column(x).to_pylist() for x in ("docs", "counts", "places")), strict=True):
            docs.append(np.repeat(np.frombuffer(d, np.int64).reshape(-1, 2), np.frombuffer(c, np.uint32), axis=0))
            places.append(np.frombuffer(p, np.uint32))
        docs, places = np.concatenate(docs), np.concatenate(places)
        order = np.lexsort((places, docs[:, 1], docs[:, 0]))
        keys, counts, places = _pack_places(docs[order], places[order])
        ends = np.cumsum(counts)
        return pa.Table.from_batches([common.arrow_batch(
            schema, doc_id=keys[:, 0], digest=keys[:, 1],
            places=[places[e - c:e].tobytes() for e, c in zip(ends, counts, strict=True)])])
    return run


def _shared_prefixes(strings: list[bytes], width: int) -> np.ndarray:
    """Common prefix of each string with the one before it."""
    n = len(strings)
    size = np.fromiter(map(len, strings), np.int64, n)
    out = np.zeros(n, np.int64)
    for k in range(0, n, 20_000):           # in pieces, as padded matrices
        lo = max(k - 1, 0)
        part = strings[lo:k + 20_000]
        m = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in part), np.uint8).reshape(len(part), width)
        equal = m[1:] == m[:-1]
        c = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
        c = np.minimum(c, np.minimum(size[lo + 1:lo + len(part)], size[lo:lo + len(part) - 1]))
        out[lo + 1:lo + len(part)] = c
    return out


def _front_code(strings: list[bytes], width: int) -> tuple[bytes, bytes]:
    shared = _shared_prefixes(strings, width)
    return shared.astype(np.uint8).tobytes(), b"".join(s[c:] for s, c in zip(strings, shared.tolist(), strict=True))


def _front_decode(shared: bytes, rests: bytes, sizes: list[int]) -> list[bytes]:
    out, last, at = [], b"", 0
    for c, n in zip(shared, sizes, strict=True):
        last = last[:c] + rests[at:at + n - c]
        at += n - c
        out.append(last)
    return out


def _make_runs(buckets: int, cfg: Settings):
    schema = common.arrow_schema(RUNS)
    nothing = pa.nulls(1, pa.binary())

    def flush(held):
        """held: (right, reversed left, id, digest, place, least, most, hash)."""
        held.sort()
        kept, settled, last = [], {}, None
        for x in held:
            if last is not None and x[:2] == last[:2]:      # same surroundings: the earlier stays
                # sorted by id, digest and place behind the strings
                if x[2:5] != last[2:5]:
                    settled.setdefault(x[2:4], []).append((x[4] - x[6], x[4] - x[5] + cfg.length))
            else:
                kept.append(x)
                last = x
        by_bucket: dict[int, list] = {}
        for x in kept:
            by_bucket.setdefault(x[7] % buckets, []).append(x)
        for k, rows in by_bucket.items():
            shared, rests = _front_code([x[0] for x in rows], cfg.length)
            lshared, lrests = _front_code([x[1] for x in rows], cfg.span)
            yield common.arrow_batch(
                schema, bucket=[k], docs=[np.array([x[2:4] for x in rows], np.int64).tobytes()],
                places=[np.array([x[4] for x in rows], np.uint32).tobytes()],
                bounds=[np.array([x[5:7] for x in rows], np.uint8).tobytes()], shared=[shared + lshared],
                rests=[rests], lefts=[lrests], spans=nothing)
        # settled spans ride along, spread over the buckets by document
        out: dict[int, list] = {}
        for (doc, digest), spans in settled.items():
            out.setdefault(digest % buckets, []).append((doc, digest, _packed(spans)))
        for k, rows in out.items():
            yield common.arrow_batch(
                schema, bucket=[k] * len(rows), docs=[np.array(r[:2], np.int64).tobytes() for r in rows],
                spans=[r[2] for r in rows],
                **{c: pa.nulls(len(rows), pa.binary()) for c in ("places", "bounds", "shared", "rests", "lefts")})

    def run(batches):
        held, size = [], 0
        for b in common.bounded(batches, budget=2 << 20):
            data, offs = common.buffers(b.column("text"))
            doc, at, h, lo, hi = anchors(data, offs, cfg)
            keys = _doc_keys(b).tolist()
            raw = data.tobytes()
            cut = np.searchsorted(doc, np.arange(len(offs)))
            for i, places in enumerate(b.column("places").to_pylist()):
                begin = int(offs[i])
                wanted = np.frombuffer(places, np.uint32).astype(np.int64) + begin
                j = np.arange(cut[i], cut[i + 1])
                j = j[np.isin(at[j], wanted)]
                for a, key, first, last in zip(at[j].tolist(), h[j].tolist(), lo[j].tolist(), hi[j].tolist(), strict=True):
                    held.append((raw[a:last + cfg.length], raw[first:a][::-1], *keys[i], a - begin, a - last, a - first,
                                 key))
                    size += last - first + cfg.length
            if size >= cfg.flush_bytes:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)
    return run


def _packed(spans: list[tuple[int, int]]) -> bytes:
    return _merge_spans(np.array(spans, np.int64)).astype(np.uint32).tobytes()


def _merge_spans(spans: np.ndarray) -> np.ndarray:
    """Union of half-open spans, ascending."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def _common(a: bytes, b: bytes, known: int) -> int:
    """Common prefix of two strings of which ``known`` bytes are known equal."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def merge_runs(runs: list[list[bytes]], shared: list) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs with a loser tree that knows common prefixes.

    ``shared[r][i]`` is the common prefix of ``runs[r][i]`` with its predecessor.
    Returns (run, index) in sorted order and the common prefix of each string
    with the one before it."""
    k = 1
    while k < len(runs):
        k *= 2
    end = len(runs)
    at = [0] * k                            # heads
    head: list[bytes | None] = [runs[r][0] if r < end and runs[r] else None for r in range(k)]
    known = [0] * k                         # common prefix of a head with the last winner
    loser = [0] * (2 * k)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's common prefix is with the winner."""
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        ca, cb = known[a], known[b]
        if ca > cb:
            return a, b
        if cb > ca:
            return b, a
        c = _common(x, y, ca)
        if x[c:c + 1] <= y[c:c + 1]:
            known[b] = c
            return a, b
        known[a] = c
        return b, a

    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], loser[node] = play(winners[2 * node], winners[2 * node + 1])
    w = winners[1] if k > 1 else 0
    order, prefixes = [], []
    while head[w] is not None:
        order.append((w, at[w]))
        prefixes.append(known[w])
        at[w] += 1
        i = at[w]
        if i < len(runs[w]):
            head[w], known[w] = runs[w][i], shared[w][i]
        else:
            head[w] = None
        node = (w + k) >> 1
        while node:
            w, loser[node] = play(w, loser[node])
            node >>= 1
    return order, prefixes


def repeated_windows(prefix: np.ndarray, lefts: np.ndarray, least: np.ndarray, most: np.ndarray, rank: np.ndarray,
                     cfg: Settings):
    """(suffix, offset) of windows that start earlier elsewhere, for suffixes in
    sorted order: ``prefix`` common prefixes, ``lefts`` the bytes left of the
    anchor (nearest first), ``least`` / ``most`` the offsets of their windows,
    ``rank`` their place in the order of documents."""
    out_s, out_o = [], []
    n = len(prefix)
    by_rank = np.argsort(rank, kind="stable")
    left_hash = np.zeros(n, U64)
    for o in range(cfg.span):
        if o:
            left_hash = left_hash * U64(0x9E3779B97F4A7C15) + lefts[:, o - 1] + U64(1)
        here = by_rank[(least[by_rank] <= o) & (most[by_rank] >= o)]
        if len(here) < 2:
            continue
        part = np.cumsum(prefix < cfg.length - o)
        key = common.mix64(common.mix64(left_hash[here]) + part[here].astype(U64))
        order = np.argsort(key, kind="stable")          # the earliest comes first
        again = np.zeros(len(here), dtype=bool)
        same = key[order][1:] == key[order][:-1]
        again[order[1:][same]] = True
        hit = here[again]
        out_s.append(hit)
        out_o.append(np.full(len(hit), o))
    return (np.concatenate(out_s), np.concatenate(out_o)) if out_s else (np.zeros(0, np.int64),) * 2


def _merge_bucket(cfg: Settings):
    schema = common.arrow_schema(SPANS)

    def run(table: pa.Table) -> pa.Table:
        rights, shares, docs, places, bounds, lefts = [], [], [], [], [], []
        found: dict[tuple[int, int], list] = {}
        for r in table.to_pylist():
            if r["spans"] is not None:
                key = tuple(np.frombuffer(r["docs"], np.int64).tolist())
                found.setdefault(key, []).append(np.frombuffer(r["spans"], np.uint32).reshape(-1, 2).astype(np.int64))
                continue
            bound = np.frombuffer(r["bounds"], np.uint8).reshape(-1, 2)
            n = len(bound)
            rights.append(_front_decode(r["shared"][:n], r["rests"], (cfg.length - bound[:, 0].astype(int)).tolist()))
            lefts.append(_front_decode(r["shared"][n:], r["lefts"], bound[:, 1].astype(int).tolist()))
            shares.append(r["shared"][:n])
            docs.append(np.frombuffer(r["docs"], np.int64).reshape(-1, 2))
            places.append(np.frombuffer(r["places"], np.uint32))
            bounds.append(bound)
        if rights:
            order, prefix = merge_runs(rights, shares)
            base = np.concatenate([[0], np.cumsum([len(x) for x in rights])])
            flat = np.array([base[r] + i for r, i in order])
            doc, place = np.concatenate(docs)[flat], np.concatenate(places)[flat].astype(np.int64)
            bound = np.concatenate(bounds)[flat].astype(np.int64)
            left = b"".join(lefts[r][i].ljust(cfg.span, b"\0") for r, i in order)
            left = np.frombuffer(left, np.uint8).reshape(len(flat), cfg.span)
            by = np.lexsort((place, doc[:, 1], doc[:, 0]))
            rank = np.empty(len(flat), np.int64)
            new = np.ones(len(flat), dtype=bool)
            new[1:] = (place[by][1:] != place[by][:-1]) | (doc[by][1:] != doc[by][:-1]).any(axis=1)
            rank[by] = np.cumsum(new)
            once = np.zeros(len(flat), dtype=bool)      # repeated rows bring one suffix twice
            once[by[new]] = True
            prefix = np.array(prefix)
            if not once.all():
                # dropping a duplicate keeps the minimum of the prefixes around it
                gone = np.flatnonzero(~once)
                for g in gone.tolist():
                    if g + 1 < len(prefix):
                        prefix[g + 1] = min(prefix[g + 1], prefix[g])
                prefix, left, bound, rank = prefix[once], left[once], bound[once], rank[once]
                doc, place = doc[once], place[once]
            s, o = repeated_windows(prefix, left, bound[:, 0], bound[:, 1], rank, cfg)
            if len(s):
                start = place[s] - o
                order = np.lexsort((start, doc[s, 1], doc[s, 0]))
                d, start = doc[s][order], start[order]
                first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]).any(axis=1)]))
                for k, part in zip(d[first].tolist(), np.split(start, first[1:]), strict=True):
                    found.setdefault(tuple(k), []).append(np.stack([part, part + cfg.length], axis=1))
        keys = list(found)
        return pa.Table.from_batches([common.arrow_batch(
            schema, doc_id=[k[0] for k in keys], digest=[k[1] for k in keys],
            spans=[_merge_spans(np.concatenate(found[k])).astype(np.uint32).tobytes() for k in keys])])
    return run


def _id_marks(bits: int):
    schema = common.arrow_schema("slot bigint")

    def run(batches):
        for b in batches:
            h = common.mix64(b.column("doc_id").fill_null(NO_ID).to_numpy().astype(np.int64).view(U64))
            yield common.arrow_batch(schema, slot=(h >> U64(64 - bits)).astype(np.int64))
    return run


def id_filter(ids: DataFrame, cfg: Settings) -> np.ndarray:
    """Bit table (at most ``2 ** filter_bits`` bits) that holds all ids; it spares
    other documents the shuffle, and lets a few of them through."""
    from .jaccard_join import FILTER, FILTER_BLOCK, _filter_block
    bits = min(cfg.filter_bits, max(FILTER_BLOCK, int(32 * ids.count()).bit_length()))
    marks = (ids.select("doc_id").mapInArrow(common.lean(_id_marks(bits)), "slot bigint").distinct()
             .withColumn("block", F.shiftright("slot", FILTER_BLOCK))
             .groupBy("block").applyInArrow(common.lean_groups(_filter_block()), FILTER))
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (FILTER_BLOCK - 3)
    for r in marks.collect():
        out[r["block"] * size:(r["block"] + 1) * size] = np.frombuffer(r["marks"], np.uint8)
    return out


def _marked(table: np.ndarray, ids: pa.Array) -> np.ndarray:
    bits = int(len(table) * 8).bit_length() - 1
    h = common.mix64(ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
    slot = (h >> U64(64 - bits)).astype(np.int64)
    return ((table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool)


def _only_marked(table: np.ndarray):
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_marked(table, b.column("doc_id"))))
    return run


def _keyed(docs: DataFrame) -> DataFrame:
    rows = common.id_and_text(docs)
    return rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("digest"), "text")


def repeated_spans(docs: DataFrame, cfg: Settings) -> DataFrame:
    """doc_id, digest, list of packed spans of every document with repeats."""
    spark = docs.sparkSession
    common.arrow_rows(spark)
    rows = _keyed(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    parts = common.n_partitions(total, cfg.anchor_bucket)
    sent = rows.mapInArrow(common.lean(_send_anchors(parts, cfg)), ANCHORS)
    places = common.saved(sent.groupBy("bucket").applyInArrow(common.lean_groups(_repeated(parts)), PARTS)
                          .groupBy("shard").applyInArrow(common.lean_groups(_by_document()), REPEATED), "repeated-anchors")
    count = places.agg(F.sum(F.octet_length("places") / 4)).first()[0]
    buckets = common.n_partitions(count, cfg.merge_bucket)
    texts = rows.mapInArrow(common.lean(_only_marked(id_filter(places, cfg))), "doc_id bigint, digest bigint, text string")
    runs = texts.join(places, ["doc_id", "digest"]).mapInArrow(common.lean(_make_runs(buckets, cfg)), RUNS)
    spans = common.saved(runs.groupBy("bucket").applyInArrow(common.lean_groups(_merge_bucket(cfg)), SPANS), "spans")
    return spans.groupBy("doc_id", "digest").agg(F.collect_list("spans").alias("spans"))


def _kept(data: np.ndarray, spans: np.ndarray) -> np.ndarray:
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, spans[:, 0], 1)
    np.add.at(change, spans[:, 1], -1)
    return data[np.cumsum(change[:-1]) == 0]


def _spans_of(parts) -> np.ndarray:
    if not parts:
        return np.zeros((0, 2), np.int64)
    return _merge_spans(np.concatenate([np.frombuffer(p, np.uint32).reshape(-1, 2) for p in parts]).astype(np.int64))


def _prepare(table: np.ndarray):
    """Rows that can't have spans are finished here and drop their text."""
    schema = common.arrow_schema(RESULT + ", digest bigint, text string")

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            hit = _marked(table, b.column("doc_id"))
            raw = [t.encode() for t in texts]
            yield common.arrow_batch(
                schema, doc_id=b.column("doc_id"), n_bytes=[len(r) for r in raw], n_removed=[0] * len(raw),
                n_spans=[0] * len(raw), kept_sha256=[hashlib.sha256(r).hexdigest() for r in raw],
                digest=b.column("digest"), text=[t if m else None for t, m in zip(texts, hit, strict=True)])
    return run


def _finisher():
    schema = common.arrow_schema(RESULT)

    def run(batches):
        for b in batches:
            removed, spans_n, digest = (b.column(c).to_pylist() for c in ("n_removed", "n_spans", "kept_sha256"))
            texts = b.column("text").to_pylist()
            for i, parts in enumerate(b.column("spans").to_pylist()):
                if parts:
                    spans = _spans_of(parts)
                    data = np.frombuffer(texts[i].encode(), np.uint8)
                    removed[i], spans_n[i] = int((spans[:, 1] - spans[:, 0]).sum()), len(spans)
                    digest[i] = hashlib.sha256(_kept(data, spans).tobytes()).hexdigest()
            ids = b.column("doc_id")
            ids = pa.compute.if_else(pa.compute.equal(ids, NO_ID), pa.scalar(None, pa.int64()), ids)
            yield common.arrow_batch(schema, doc_id=ids, n_bytes=b.column("n_bytes"), n_removed=removed,
                                     n_spans=spans_n, kept_sha256=digest)
    return run


def removals(docs: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    cfg = cfg or Settings()
    spans = common.saved(repeated_spans(docs, cfg), "document-spans")
    rows = _keyed(docs).mapInArrow(common.lean(_prepare(id_filter(spans, cfg))), RESULT + ", digest bigint, text string")
    return rows.join(spans, ["doc_id", "digest"], "left").mapInArrow(common.lean(_finisher()), RESULT)


def cut_documents(docs: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """``docs`` with repeats cut out of ``text`` (code points that are cut in two
    go) and ``n_chars``, where present, counted anew.  Documents of which
    nothing stays go; those that lose nothing stay as they are."""
    cfg = cfg or Settings()
    spans = common.saved(repeated_spans(docs, cfg), "document-spans").select(
        F.col("doc_id").alias("_span_id"), F.col("digest").alias("_span_digest"), F.col("spans").alias("_spans"))

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd
        out = []
        for t, parts in zip(text, spans, strict=True):
            if t is not None and parts is not None and len(parts):
                data = np.frombuffer(t.encode(), np.uint8)
                t = _kept(data, _spans_of(list(parts))).tobytes().decode("utf-8", "ignore")
            out.append(t)
        common.give_back()
        return pd.Series(out, dtype=object)

    joined = docs.join(spans, (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == F.col("_span_id"))
                       & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_span_digest")), "left")
    after = cut(docs["text"], F.col("_spans"))
    out = joined.select(*[after.alias("text") if c == "text" else docs[c] for c in docs.columns], "_spans")
    out = out.filter(F.col("_spans").isNull() | (F.length("text") > 0)).drop("_spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
