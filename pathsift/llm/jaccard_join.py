"""Operator 7, n-gram Jaccard join with rare-first prefix filtering.

A text's set holds the hashes of its distinct word n-grams.  Texts with equal
sets form one class; the join runs between classes.

1. One pass gives each document's set size, its 128-bit class, the parities of
   its n-grams over 512 cells, and a sketch of
   n-gram frequencies over all documents (a fixed table of counters).  Its
   levels define the global rare-first order; any order gives the same links,
   a good one gives few candidates.
2. Each class sends the first ``size - ceil(t * size) + 1`` n-grams of that
   order, with their positions, to buckets by n-gram.  Two linked classes share
   at least one of them.
3. Classes that share such an n-gram form a group.  Length and positional
   filters discard pairs; to avoid emitting all pairs, each member is first
   paired with its group's pivot only.  Every n-gram that one of two sets lacks
   flips one parity, so differing parities bound the sets' difference from below:
   pairs that share a rare n-gram by chance go before any set travels.  The
   others are verified (suffix filter by hash ranges, then exact intersection of
   whole hashes), once per pair, and components are formed.  Then all remaining
   pairs of a group that lie in different components are verified, so no link
   between components is lost.
4. Components label all classes and, through them, all documents.

No step has a cap; groups whose members are already connected need no pairs.

Defined results: null or wordless text has size 0 and is alone; with fewer
words than n the whole sequence is one n-gram; repeated rows each return a
row; null ids never become a component's id; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64
from .components import connected

PARITIES = 8
BITS = [f"p{k}" for k in range(PARITIES)]
SIZES = ("doc_id bigint, key binary, n bigint, cls binary, block int, task int, counts binary, "
         + ", ".join(f"{c} bigint" for c in BITS))
COUNTS = "block int, task int, counts binary"
ENTRIES = "bucket int, classes binary, sizes binary, which binary, grams binary, ranks binary"
MEMBERS = "gram bigint, cls binary, n int, pos int, pivots array<binary>, more boolean"
SETS = "cls binary, n int, grams binary"
FILTER = "block bigint, marks binary"
LINKS = "a binary, b binary"
#: Bits (as a power of two) of one block of the class filter.
FILTER_BLOCK = 14


@dataclass
class Settings:
    words: int = 5
    percent: int = 75
    sketch_bits: int = 20
    block_bits: int = 14
    fan_in: int = 64
    bucket_bytes: int = 24 << 20
    flush_bytes: int = 12 << 20
    filter_bits: int = 27
    star_turns: int = 1

    def needed(self, n):
        """Fewest common n-grams of a set of size n with any set it links to."""
        return -(-n * self.percent // 100)

    def overlap(self, n, m):
        """Fewest common n-grams of linked sets of sizes n and m."""
        return -(-(n + m) * self.percent // (100 + self.percent))


def sets_of(col: pa.Array, cfg: Settings):
    """Distinct n-gram hashes, ascending inside each document; the document of
    each; set sizes."""
    data, offs = common.buffers(col)
    count = len(offs) - 1
    s, e, doc = common.word_ranges(data, offs)
    h = common.range_hashes(data, s, e)
    g, at = common.gram_hashes(h, doc, cfg.words)
    d = doc[at]
    words = np.bincount(doc, minlength=count)
    first = np.concatenate([[0], np.cumsum(words)[:-1]]).astype(np.int64) if count else np.zeros(0, np.int64)
    for w in range(1, cfg.words):
        short = np.flatnonzero(words == w)
        if len(short):
            acc = np.full(len(short), w, U64)
            for k in range(w):
                acc = acc * U64(0xA24BAED4963EE407) + h[first[short] + k]
            g, d = np.concatenate([g, common.mix64(acc)]), np.concatenate([d, short])
    g, d = _by_document(g, d, g)
    if len(g):
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])
        g, d = g[new], d[new]
    return g, d, np.bincount(d, minlength=count)


def _by_document(g, d, key):
    """Sort by document, then key."""
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(d[order].astype(np.uint16) if len(d) and d.max() < 65536 else d[order], kind="stable")]
    return g[order], d[order]


def classes_of(g, d, n) -> np.ndarray:
    """128-bit digests of the sets, as pairs of integers."""
    out = np.empty((len(n), 2), U64)
    ends = np.cumsum(n)
    for k in range(2):
        c = np.zeros(len(g) + 1, U64)
        np.cumsum(common.mix64(g + U64(0x632BE59BD9B4E019 * (k + 1) & (2 ** 64 - 1))), out=c[1:])
        out[:, k] = common.mix64(c[ends] - c[ends - n] + n.astype(U64))
    return out


def parities_of(g, d, count: int) -> np.ndarray:
    """Parity of the n-grams in each of 512 cells, as integers per document."""
    cells = 64 * PARITIES
    odd = np.bincount(d * cells + (g >> U64(20)).astype(np.int64) % cells, minlength=count * cells) & 1
    return np.packbits(odd.astype(np.uint8).reshape(count, cells), axis=1).view(np.int64).reshape(count, PARITIES)


def _binary(classes: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(classes).view(np.uint8).reshape(-1)
    offs = np.arange(len(classes) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(classes), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(raw.tobytes())])


def _measure(cfg: Settings):
    schema = common.arrow_schema(SIZES)

    def run(batches):
        sketch = np.zeros(1 << cfg.sketch_bits, np.uint32)
        for b in common.bounded(batches):
            g, d, n = sets_of(b.column("text"), cfg)
            sketch += np.bincount((g >> U64(64 - cfg.sketch_bits)).astype(np.int64),
                                  minlength=len(sketch)).astype(np.uint32)
            key = b.column("key") if "key" in b.schema.names else pa.nulls(len(n), pa.binary())
            yield common.arrow_batch(schema, doc_id=b.column("doc_id"), key=key, n=n, cls=_binary(classes_of(g, d, n)),
                                     block=pa.nulls(len(n), pa.int32()), task=pa.nulls(len(n), pa.int32()),
                                     counts=pa.nulls(len(n), pa.binary()),
                                     **dict(zip(BITS, parities_of(g, d, len(n)).T.copy(), strict=True)))
        size = 1 << cfg.block_bits
        task = TaskContext.get().partitionId()
        for k in range(0, len(sketch), size):
            part = sketch[k:k + size]
            if part.any():
                yield common.arrow_batch(schema, doc_id=[None], key=[None], n=[None], cls=[None], block=[k // size], task=[task],
                                         counts=[part.tobytes()], **{c: [None] for c in BITS})
    return run


def _add_counts():
    schema = common.arrow_schema(COUNTS)

    def run(table: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(c, np.uint32).astype(np.uint64) for c in table.column("counts").to_pylist())
        return pa.Table.from_batches([common.arrow_batch(
            schema, block=[table.column("block")[0].as_py()], task=[table.column("task")[0].as_py()],
            counts=[np.minimum(counts, 2 ** 32 - 1).astype(np.uint32).tobytes()])])
    return run


def frequency_levels(measured: DataFrame, cfg: Settings) -> np.ndarray:
    """One byte per sketch cell: eighths of the binary logarithm of its count.
    The table's size is fixed, and at most ``fan_in`` rows meet in a task."""
    parts = measured.filter("block is not null").select("block", "task", "counts")
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        tasks = -(-tasks // cfg.fan_in)
        parts = (parts.withColumn("task", (F.col("task") % tasks).cast("int"))
                 .groupBy("block", "task").applyInArrow(common.lean_groups(_add_counts()), COUNTS))
    out = np.zeros(1 << cfg.sketch_bits, np.uint32)
    size = 1 << cfg.block_bits
    for r in parts.collect():
        out[r["block"] * size:(r["block"] + 1) * size] = np.frombuffer(r["counts"], np.uint32)
    return np.minimum(np.log2(1.0 + out) * 8, 255).astype(np.uint8)


def _prefixes(levels: np.ndarray, buckets: int, cfg: Settings):
    schema = common.arrow_schema(ENTRIES)

    def flush(held):
        classes, sizes, which, grams, ranks = (np.concatenate(x) for x in zip(*held, strict=True))
        home = (grams % U64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[order], np.arange(buckets + 1))
        for k in range(buckets):
            at = order[cut[k]:cut[k + 1]]
            if not len(at):
                continue
            used, inv = np.unique(which[at], return_inverse=True)
            yield common.arrow_batch(
                schema, bucket=[k], classes=[classes[used].tobytes()], sizes=[sizes[used].astype(np.int32).tobytes()],
                which=[inv.astype(np.int32).tobytes() if len(used) > 65535 else inv.astype(np.uint16).tobytes()],
                # 40 bits within the bucket: a chance match only adds a candidate
                grams=[np.ascontiguousarray((grams[at] >> U64(24)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()],
                ranks=[ranks[at].astype(np.int32).tobytes()])

    def run(batches):
        held, seen, size, total = [], set(), 0, 0
        for b in common.bounded(batches):
            g, d, n = sets_of(b.column("text"), cfg)
            cls = classes_of(g, d, n)
            new = np.zeros(len(n), dtype=bool)
            for i, key in enumerate(map(bytes, cls)):           # one entry per class and task
                if n[i] and key not in seen:
                    seen.add(key)
                    new[i] = True
            level = levels[(g >> U64(64 - cfg.sketch_bits)).astype(np.int64)].astype(U64)
            g, d = _by_document(g, d, (level << U64(56)) | (g >> U64(8)))
            rank = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
            take = new[d] & (rank < (n - cfg.needed(n) + 1)[d])
            ids = np.cumsum(new) - 1
            held.append((cls[new], n[new], total + ids[d[take]], g[take], rank[take]))
            total += int(new.sum())
            size += int(take.sum()) * 16
            if size > cfg.flush_bytes:
                yield from flush(held)
                held, size, total = [], 0, 0
        if held and total:
            yield from flush(held)
    return run


def _reachable(gram, n, rank, cfg: Settings) -> np.ndarray:
    """Members (sorted by n-gram and size) that may link to another one: the
    overlap needed is least with the smallest partner of allowed length."""
    if not len(gram):
        return np.zeros(0, dtype=bool)
    group = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))
    span = int(n.max()) + 2
    at = np.searchsorted(group * span + n, group * span + cfg.needed(n))
    own = np.arange(len(gram))
    at = np.where(at == own, own + 1, at)
    inside = at < len(gram)
    at = np.minimum(at, len(gram) - 1)
    inside &= group[at] == group
    return inside & (cfg.needed(n[at]) <= n) & (np.minimum(n - rank, n[at]) >= cfg.overlap(n, n[at]))


def _groups(cfg: Settings):
    schema = common.arrow_schema(MEMBERS)

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        cls, n, gram, rank = [], [], [], []
        for c, s, w, g, r in zip(*(table.column(x).to_pylist() for x in ("classes", "sizes", "which", "grams", "ranks")),
                                 strict=True):
            c, s = np.frombuffer(c, U64).reshape(-1, 2), np.frombuffer(s, np.int32)
            r = np.frombuffer(r, np.int32)
            w = np.frombuffer(w, np.int32 if len(w) == 4 * len(r) else np.uint16)
            wide = np.zeros((len(r), 8), np.uint8)
            wide[:, :5] = np.frombuffer(g, np.uint8).reshape(-1, 5)
            cls.append(c[w])
            n.append(s[w])
            gram.append(wide.view(np.int64).ravel())
            rank.append(r)
        cls, n, gram, rank = (np.concatenate(x) for x in (cls, n, gram, rank))
        # only n-grams of two members or more
        _, inv, times = np.unique(gram, return_inverse=True, return_counts=True)
        many = times[inv] > 1
        cls, n, gram, rank = cls[many], n[many], gram[many], rank[many]
        order = np.lexsort((cls[:, 1], cls[:, 0], n, gram))
        cls, n, gram, rank = cls[order], n[order], gram[order], rank[order]
        if len(gram):       # a class that several tasks sent
            new = np.ones(len(gram), dtype=bool)
            new[1:] = (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1]).any(axis=1)
            cls, n, gram, rank = cls[new], n[new], gram[new], rank[new]
        # a member whose rest can't reach the overlap with its least partner has none here
        for _ in range(2):
            may = _reachable(gram, n.astype(np.int64), rank, cfg)
            cls, n, gram, rank = cls[may], n[may], gram[may], rank[may]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
        length = np.diff(np.append(first, len(gram)))
        pivot = np.repeat(first, length)
        # a member too long for its pivot starts a part of its own
        far = np.unique(pivot[cfg.needed(n.astype(np.int64)) > n[pivot]]) if len(gram) else []
        end = dict(zip(first.tolist(), (first + length).tolist(), strict=True))
        for p in far:
            k, stop = int(p), end[int(p)]
            while k < stop:
                limit = n[k] * 100 // cfg.percent
                to = k + int(np.searchsorted(n[k:stop], limit, side="right"))
                pivot[k:to] = k
                k = to
        keep = np.repeat(length > 1, length)
        own, size = np.arange(len(gram)), n.astype(np.int64)
        # pivots of a part: its smallest set, and the one with the earliest position
        by_rank = np.lexsort((rank, pivot))
        part, at = np.unique(pivot[by_rank], return_index=True)
        early = by_rank[at][np.searchsorted(part, pivot)]
        hubs, ok = [], []
        for a in (pivot, early):
            hubs.append(a)
            ok.append((a != own) & (np.minimum(n[a] - rank[a], n - rank) >= cfg.overlap(size[a], size)))
        hubs, ok = np.stack(hubs, axis=1), np.stack(ok, axis=1)
        # groups of two, and of three with two pivots, are settled by their pivot pairs
        group, members = np.repeat(np.arange(len(first)), length), np.repeat(length, length)
        whole = np.bincount(group, weights=own == pivot, minlength=len(first))[group] == 1
        more = (members > 2) & ~((members == 3) & whole & (pivot != early))
        offsets = np.concatenate([[0], np.cumsum(ok.sum(axis=1))]).astype(np.int32)
        pivots = pa.ListArray.from_arrays(pa.array(offsets), _binary(cls[hubs[ok]]))
        out = common.arrow_batch(schema, gram=(np.int64(bucket) << 40) | gram, cls=_binary(cls), n=n, pos=rank,
                                 pivots=pivots.cast(schema.field("pivots").type), more=more)
        return pa.Table.from_batches([out.filter(pa.array(keep)) if len(gram) else out])
    return run


def _slots(classes: np.ndarray, bits: int) -> np.ndarray:
    return (classes[:, 0] >> U64(64 - bits)).astype(np.int64)


def _slot_rows(bits: int):
    schema = common.arrow_schema("slot bigint")

    def run(batches):
        for b in batches:
            cls = np.frombuffer(b"".join(b.column("cls").to_pylist()), U64).reshape(-1, 2)
            yield common.arrow_batch(schema, slot=_slots(cls, bits))
    return run


def _filter_block():
    schema = common.arrow_schema(FILTER)

    def run(table: pa.Table) -> pa.Table:
        here = np.zeros(1 << FILTER_BLOCK, dtype=bool)
        here[table.column("slot").to_numpy() & (len(here) - 1)] = True
        return pa.Table.from_batches([common.arrow_batch(
            schema, block=[table.column("block")[0].as_py()], marks=[np.packbits(here).tobytes()])])
    return run


def class_filter(classes: DataFrame, cfg: Settings) -> np.ndarray:
    """A bit table that holds all of ``classes`` (a Bloom filter of one hash).
    It has at most ``2 ** filter_bits`` bits; more classes make it let through
    sets that no pair asks for, never lose one."""
    count = classes.count()
    bits = min(cfg.filter_bits, max(FILTER_BLOCK, int(64 * count).bit_length()))
    marks = (classes.mapInArrow(common.lean(_slot_rows(bits)), "slot bigint").distinct()
             .withColumn("block", F.shiftright("slot", FILTER_BLOCK))
             .groupBy("block").applyInArrow(common.lean_groups(_filter_block()), FILTER))
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (FILTER_BLOCK - 3)
    for r in marks.collect():
        out[r["block"] * size:(r["block"] + 1) * size] = np.frombuffer(r["marks"], np.uint8)
    return out


def _sets(wanted: np.ndarray, cfg: Settings):
    """Sets of the classes that pass the filter, once per task."""
    schema = common.arrow_schema(SETS)
    bits = int(len(wanted) * 8).bit_length() - 1

    def run(batches):
        seen: set[bytes] = set()
        for b in common.bounded(batches):
            g, d, n = sets_of(b.column("text"), cfg)
            classes = classes_of(g, d, n)
            slot = _slots(classes, bits)
            pick = (wanted[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1
            ends, rows = np.cumsum(n), []
            for i in np.flatnonzero((pick == 1) & (n > 0)):
                key = classes[i].tobytes()
                if key not in seen:
                    seen.add(key)
                    rows.append(i)
            yield common.arrow_batch(schema, cls=_binary(classes[rows]), n=n[rows].astype(np.int32),
                                     grams=[g[ends[i] - n[i]:ends[i]].tobytes() for i in rows])
    return run


_RANGES = np.arange(1, 16, dtype=U64) << U64(60)


def linked(x: np.ndarray, y: np.ndarray, cfg: Settings) -> bool:
    """Suffix filter by hash ranges, then the exact intersection of two sorted
    sets."""
    n, m = len(x), len(y)
    need = cfg.overlap(n, m)
    if min(n, m) < need:
        return False
    cx = np.diff(np.concatenate([[0], np.searchsorted(x, _RANGES), [n]]))
    cy = np.diff(np.concatenate([[0], np.searchsorted(y, _RANGES), [m]]))
    if np.minimum(cx, cy).sum() < need:
        return False
    if n > m:
        x, y = y, x
    at = np.searchsorted(y, x)
    common_grams = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * common_grams >= cfg.percent * (n + m - common_grams)


def _verify(cfg: Settings):
    schema = common.arrow_schema(LINKS)

    def run(batches):
        for b in batches:
            left, right = b.column("grams_a"), b.column("grams_b")
            ok = [linked(np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64), cfg)
                  for x, y in zip(left, right, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_())).cast(schema)
    return run


def _near(pairs: DataFrame, classes: DataFrame, cfg: Settings) -> DataFrame:
    """The pairs (a, b) whose parities don't rule out a link."""
    for side in "ab":
        own = [F.col(c).alias(f"{side}_{c}") for c in ("n", *BITS)]
        pairs = pairs.join(classes.select(F.col("cls").alias(side), *own), side)
    differ = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in BITS), F.lit(0))
    both = F.col("a_n") + F.col("b_n")
    need = F.ceil(both * cfg.percent / (100 + cfg.percent))
    return pairs.filter(differ <= both - 2 * need).select("a", "b")


def _verified(pairs: DataFrame, text: DataFrame, cfg: Settings) -> DataFrame:
    """The links among written pairs (a, b).  Only the sets that these pairs
    name are made; one shuffle of them serves both joins."""
    named = class_filter(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), cfg)
    sets = text.mapInArrow(common.lean(_sets(named, cfg)), SETS).dropDuplicates(["cls"])
    b = sets.select(F.col("cls").alias("b"), F.col("grams").alias("grams_b"))
    a = sets.select(F.col("cls").alias("a"), F.col("grams").alias("grams_a"))
    return common.saved(pairs.join(b, "b").join(a, "a").mapInArrow(common.lean(_verify(cfg)), LINKS), "links")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose classes lie in different components."""
    for side in "ab":
        of = labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
        pairs = pairs.join(of, side, "left").withColumn(f"{side}_label", F.coalesce(f"{side}_label", side))
    return pairs.filter("a_label <> b_label").select("a", "b")


def _may_link(n, pos, m, at, cfg: Settings):
    """Length and positional filters as a column."""
    need = F.ceil((n + m) * cfg.percent / (100 + cfg.percent))
    return (F.least(n, m) >= need) & (F.least(n - pos, m - at) >= need)


def _placed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the groups that still span components, with their labels."""
    placed = common.saved(members.join(labels, members["cls"] == labels["node"], "left").select(
        "gram", "cls", "n", "pos", F.coalesce("label", "cls").alias("label")), "placed")
    apart = (placed.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
             .filter("lo <> hi").select("gram"))
    return common.saved(placed.join(apart, "gram", "left_semi"), "apart")


def _star_pairs(apart: DataFrame, turn: int, cfg: Settings) -> DataFrame:
    """In even turns, each member outside its group's largest component with the
    earliest member of that; in odd turns, with the group's earliest member."""
    first = F.min(F.struct("pos", F.xxhash64("cls", F.lit(turn)).alias("k"), "cls", "n"))
    if turn % 2:
        hubs = apart.groupBy("gram").agg(F.min(F.struct("pos", F.xxhash64("cls", F.lit(turn)).alias("k"), "cls", "n",
                                                        "label")).alias("hub")).withColumn("to", F.col("hub.label"))
    else:
        parts = apart.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("c"), first.alias("hub"))
        hubs = (parts.groupBy("gram").agg(F.max(F.struct("c", "label", "hub")).alias("h"))
                .select("gram", F.col("h.hub").alias("hub"), F.col("h.label").alias("to")))
    hubs = hubs.select("gram", "to", F.col("hub.cls").alias("hub"), F.col("hub.n").alias("hub_n"),
                       F.col("hub.pos").alias("hub_pos"))
    return (apart.join(hubs, "gram").filter("label <> to")
            .filter(_may_link(F.col("n"), F.col("pos"), F.col("hub_n"), F.col("hub_pos"), cfg))
            .select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct())


def _pairs_apart(apart: DataFrame, cfg: Settings) -> DataFrame:
    """All pairs of a group that lie in different components."""
    x, y = apart.alias("x"), apart.alias("y")
    return (x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.label") < F.col("y.label"))
                   & _may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), cfg))
            .select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct())


def _resolved(rows: DataFrame, cfg: Settings) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, n, cls of every row (columns doc_id, text and, where wanted,
    key); cls, component_id and label, the component's least class, of every class."""
    common.arrow_rows(rows.sparkSession)
    text = rows.select("text")
    measured = common.saved(rows.mapInArrow(common.lean(_measure(cfg)), SIZES), "set-sizes")
    levels = frequency_levels(measured, cfg)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    buckets = common.n_partitions(total, cfg.bucket_bytes)
    members = common.saved(text.mapInArrow(common.lean(_prefixes(levels, buckets, cfg)), ENTRIES)
                           .groupBy("bucket").applyInArrow(common.lean_groups(_groups(cfg)), MEMBERS), "members")
    sized = measured.filter("block is null")
    classes = common.saved(sized.filter("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.min("n").alias("n"), *[F.min(c).alias(c) for c in BITS]), "classes")
    sized = sized.select("doc_id", "key", "n", "cls")
    pivots = (members.select(F.explode("pivots").alias("u"), F.col("cls").alias("v"))
              .select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
    pairs = common.saved(_near(pivots, classes, cfg), "pairs")
    # each class with its least partner first; then only the pairs that still lie apart
    first = common.saved(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    links = _verified(first, text, cfg)
    labels = common.saved(connected(links), "labels")
    rest = common.saved(_apart(pairs.join(first, ["a", "b"], "left_anti"), labels), "pairs")
    links = links.unionByName(_verified(rest, text, cfg))
    labels = common.saved(connected(links), "labels")
    members = members.filter("more")
    for turn in range(cfg.star_turns + 1):
        members = _placed(members.select("gram", "cls", "n", "pos"), labels)
        new = _pairs_apart(members, cfg) if turn == cfg.star_turns else _star_pairs(members, turn, cfg)
        # pairs seen before are verified or inside a component
        new = common.saved(_near(new.join(pairs, ["a", "b"], "left_anti"), classes, cfg), "pairs")
        pairs, links = pairs.unionByName(new), links.unionByName(_verified(new, text, cfg))
        labels = common.saved(connected(links), "labels")

    # a component's id is the least document id of its classes
    of_class = classes.join(labels, classes["cls"] == labels["node"], "left").select(
        "cls", "rep", F.coalesce("label", "cls").alias("label"))
    ids = of_class.groupBy("label").agg(F.min("rep").alias("component_id"))
    return sized, common.saved(of_class.join(ids, "label").select("cls", "component_id", "label"), "class-components")


def components(docs: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    sized, of_class = _resolved(common.id_and_text(docs), cfg or Settings())
    return (sized.join(of_class.select("cls", "component_id"), "cls", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "doc_id").alias("component_id")))


def first_keys(rows: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """Of ``rows`` (doc_id, text, and key, a digest of both) the key of each
    component's first row, by doc_id (null last) and key; texts without
    n-grams are no near duplicates and keep each key."""
    sized, of_class = _resolved(rows, cfg or Settings())
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    firsts = sized.filter("n > 0").groupBy("cls").agg(F.min(first).alias("first"))
    firsts = firsts.join(of_class, "cls").groupBy("label").agg(F.min("first").alias("first")).select("first.key")
    return firsts.unionByName(sized.filter("n = 0").select("key").distinct())
