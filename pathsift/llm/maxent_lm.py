"""Operator 5, language-model scoring: a hashed maximum-entropy model.

Every token has a class; ``P(token | history) = P(class | history) *
P(token | class, history)``.  The most frequent training words fill head
classes of ``slots`` words each; all other words fall into tail classes by
their last bytes.  Class scores are sums of parameter rows picked by hashed
features of the history: the previous token, the one before it (skip) and
the pair (n-gram).  Inside a head class a second table picks rows by class
and history; inside a tail class tokens follow their add-one counts, with one
event for all unseen tokens, so all probabilities of a history sum to 1.

Training: token counts over all training texts start the biases; then the
training texts, in ``rounds`` parts by a hash of the id, run through
distributed gradient updates: tasks take gradient steps (AdaGrad) over their
texts from the round's parameters and send their changes, which are averaged
row by row on the executors; a few megabytes of parameters, whatever the size
of the corpus, pass through the driver.

Counts: words that hold at least ``1 / broadcast_words`` of all training
tokens are broadcast (so at most that many), the rest meet their counts in a
join on the word, whose keys are therefore never hot.

Defined results: null or empty text is the one end token; a null id is part of
the training rows; repeated rows return a row each; without training texts
every base score is 0; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64

FOLDS, HELD_OUT = 7, 2
END = np.uint64(0xE4D0E4D0E4D0E4D1)
COUNTS = "h bigint, tail int, c bigint"
CHANGES = "block int, task int, rows binary, hits binary, change binary"
#: Tasks whose changes meet in one step of the averaging tree.
FAN_IN = 64
PARTIAL = ("row bigint, doc_id bigint, held_out boolean, h bigint, n bigint, n_tokens bigint, n_known bigint, "
           "base double, score double")


@dataclass
class Settings:
    head_classes: int = 24
    slots: int = 32
    tail_classes: int = 40
    pair_rows: int = 1 << 13
    inner_rows: int = 1 << 14
    rounds: int = 4
    rate: float = 0.15
    chunk: int = 16_384
    broadcast_words: int = 1 << 21
    flush_tokens: int = 1 << 21
    task_bytes: int = 64 << 20
    block_rows: int = 1024

    @property
    def classes(self):
        return self.head_classes + self.tail_classes

    @property
    def symbols(self):
        return self.head_classes * self.slots + self.tail_classes + 1

    @property
    def class_rows(self):
        return 1 + 2 * self.symbols + self.pair_rows


def held_out():
    return F.coalesce(common.crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))


def token_stream(col: pa.Array, tails: int):
    """Token hashes with one END after each document, tail class of each token
    and the document of each token."""
    data, offs = common.buffers(col)
    n = len(offs) - 1
    s, e, doc = common.word_ranges(data, offs)
    sums = common.prefix_sums(data)
    h = common.range_hashes(data, s, e, sums=sums)
    tail = (common.range_hashes(data, np.maximum(e - 2, s), e, sums=sums) % U64(tails)).astype(np.int32)
    words = np.bincount(doc, minlength=n)
    ends = np.cumsum(words) + np.arange(n)
    all_h, all_t = np.full(len(h) + n, END, U64), np.zeros(len(h) + n, np.int32)
    at = np.arange(len(h)) + doc
    all_h[at], all_t[at] = h, tail
    all_d = np.repeat(np.arange(n), words + 1)
    return all_h, all_t, all_d, ends


def _count(cfg: Settings):
    schema = common.arrow_schema(COUNTS)

    def flush(hs, ts):
        h = np.concatenate(hs)
        u, first, c = np.unique(h, return_index=True, return_counts=True)
        return common.arrow_batch(schema, h=u.view(np.int64), tail=np.concatenate(ts)[first], c=c.astype(np.int64))

    def run(batches):
        hs, ts, held = [], [], 0
        for b in common.bounded(batches):
            h, t, _, _ = token_stream(b.column("text"), cfg.tail_classes)
            hs.append(h)
            ts.append(t)
            held += len(h)
            if held >= cfg.flush_tokens:
                yield flush(hs, ts)
                hs, ts, held = [], [], 0
        if held:
            yield flush(hs, ts)
    return run


@dataclass
class Model:
    """Parameters and the counts that every task needs."""

    cfg: Settings
    train_tokens: int
    distinct: int
    head: np.ndarray            # hashes of the head words, ascending
    head_symbol: np.ndarray     # their symbols: class * slots + slot
    tail_log: np.ndarray        # log10 of each tail class's token mass
    known: np.ndarray           # hashes of the broadcast words, ascending
    known_count: np.ndarray
    outer: np.ndarray           # class_rows x classes; row 0 is the bias
    inner_bias: np.ndarray      # head_classes x slots
    inner: np.ndarray           # inner_rows x slots

    def symbols(self, h, tail):
        at = np.minimum(np.searchsorted(self.head, h), max(len(self.head) - 1, 0))
        out = (self.cfg.head_classes * self.cfg.slots + tail).astype(np.int64)
        if len(self.head):
            hit = self.head[at] == h
            out[hit] = self.head_symbol[at[hit]]
        return out

    def history(self, sym, doc):
        """Rows of the class table and of the in-class table, per token."""
        cfg = self.cfg
        begin = cfg.symbols - 1
        p1, p2 = np.full(len(sym), begin), np.full(len(sym), begin)
        if len(sym) > 1:
            p1[1:] = np.where(doc[1:] == doc[:-1], sym[:-1], begin)
        if len(sym) > 2:
            p2[2:] = np.where(doc[2:] == doc[:-2], sym[:-2], begin)
        pair = (common.mix64((p1 * cfg.symbols + p2).astype(U64)) % U64(cfg.pair_rows)).astype(np.int64)
        outer = np.stack([1 + p1, 1 + cfg.symbols + p2, 1 + 2 * cfg.symbols + pair])
        cls = np.where(sym < cfg.head_classes * cfg.slots, sym // cfg.slots, sym - cfg.head_classes * (cfg.slots - 1))
        inner = np.stack([(common.mix64(((cls * 2 + k) * cfg.symbols + p + 1).astype(U64)) % U64(cfg.inner_rows))
                          .astype(np.int64) for k, p in enumerate((p1, p2))])
        return outer, inner, cls

    def class_logits(self, rows):
        z = np.take(self.outer, rows[0], axis=0)
        for r in rows[1:]:
            z += np.take(self.outer, r, axis=0)
        z += self.outer[0]
        return z

    def slot_logits(self, rows, cls):
        z = np.take(self.inner_bias, cls, axis=0)
        for r in rows:
            z += np.take(self.inner, r, axis=0)
        return z


#: Tokens whose scores are made at a time: few enough to stay in the cache.
PIECE = 2_048
#: Rows of a run that are summed across runs; longer runs are summed one by one.
FEW = 8


def _log_softmax(z):
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def _probabilities(logits, n, width):
    """Softmax of ``logits(piece)`` for ``n`` tokens, piece by piece."""
    out = np.empty((n, width), np.float32)
    for k in range(0, n, PIECE):
        p = slice(k, k + PIECE)
        np.exp(_log_softmax(logits(p)), out=out[p])
    return out


def _log_chosen(z, at):
    """Log softmax of one column per row."""
    z -= z.max(axis=1, keepdims=True)
    chosen = z[np.arange(len(at)), at]
    return chosen - np.log(np.exp(z, out=z).sum(axis=1))


def _row_sums(rows, err):
    """Sums of ``err`` by row number."""
    if rows.max() < 1 << 16:
        rows = rows.astype(np.uint16)       # sorted by radix
    order = np.argsort(rows, kind="stable")
    sorted_rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
    count = np.diff(first, append=len(rows))
    out = np.take(err, order[first], axis=0)
    # runs of up to FEW: their second rows are summed at once, then their third rows, ...
    run = np.flatnonzero((count > 1) & (count <= FEW))
    rest = np.take(err, order[first[run] + 1], axis=0)
    for k in range(2, FEW):
        longer = np.flatnonzero(count[run] > k)
        rest[longer] += np.take(err, order[first[run[longer]] + k], axis=0)
    out[run] += rest
    many = count > FEW
    if many.any():
        rows_of = np.take(err, order[np.repeat(many, count)], axis=0)
        size = count[many]
        out[many] = np.add.reduceat(np.ascontiguousarray(rows_of.T), np.cumsum(size) - size, axis=1).T
    return sorted_rows[first], out


def _step(m: Model, sym, doc, acc, touched):
    """Gradient steps over the tokens of one batch, in place."""
    cfg = m.cfg
    outer, inner, cls = m.history(sym, doc)
    heads = cfg.head_classes * cfg.slots
    for k in range(0, len(sym), cfg.chunk):
        part = slice(k, min(k + cfg.chunk, len(sym)))
        rows, c = outer[:, part], cls[part]
        err = _probabilities(lambda p: m.class_logits(rows[:, p]), len(c), cfg.classes)  # noqa: B023
        err[np.arange(len(c)), c] -= 1
        bias = np.zeros(1, np.int64), np.add.reduceat(np.ascontiguousarray(err.T), [0], axis=1).T
        for u, g in (bias, *(_row_sums(r, err) for r in rows)):
            acc[0][u] += g * g
            m.outer[u] -= cfg.rate * g / np.sqrt(acc[0][u])
            touched[0][u] = True
        at = np.flatnonzero(sym[part] < heads)
        if not len(at):
            continue
        rows, c, slot = inner[:, part][:, at], c[at], sym[part][at] % cfg.slots
        err = _probabilities(lambda p: m.slot_logits(rows[:, p], c[p]), len(c), cfg.slots)  # noqa: B023
        err[np.arange(len(at)), slot] -= 1
        for r in rows:
            u, g = _row_sums(r, err)
            acc[1][u] += g * g
            m.inner[u] -= cfg.rate * g / np.sqrt(acc[1][u])
            touched[1][u] = True


def _train(model: Model):
    """Local steps of a task; yields the changed rows, block by block."""
    schema = common.arrow_schema(CHANGES)
    cfg = model.cfg

    def run(batches):
        m = Model(**{**model.__dict__, "outer": model.outer.copy(), "inner": model.inner.copy()})
        acc = [np.ones_like(m.outer), np.ones_like(m.inner)]
        touched = [np.zeros(len(m.outer), bool), np.zeros(len(m.inner), bool)]
        task = TaskContext.get().partitionId()
        for b in common.bounded(batches):
            h, t, doc, _ = token_stream(b.column("text"), cfg.tail_classes)
            _step(m, m.symbols(h, t), doc, acc, touched)
        block = 0
        for new, old, hit in ((m.outer, model.outer, touched[0]), (m.inner, model.inner, touched[1])):
            for k in range(0, len(new), cfg.block_rows):
                rows = np.flatnonzero(hit[k:k + cfg.block_rows])
                if len(rows):
                    change = (new[k + rows] - old[k + rows]).astype(np.float32)
                    yield common.arrow_batch(
                        schema, block=[block], task=[task], rows=[rows.astype(np.int16).tobytes()],
                        hits=[np.ones(len(rows), np.int32).tobytes()], change=[change.tobytes()])
                block += 1
    return run


def _combine(cfg: Settings):
    """Sum the changes of a block, and the number of tasks that touched a row."""
    schema = common.arrow_schema(CHANGES)

    def run(table: pa.Table) -> pa.Table:
        total, hits = None, np.zeros(cfg.block_rows, np.int32)
        for rows, times, change in zip(*(table.column(c).to_pylist() for c in ("rows", "hits", "change")), strict=True):
            at = np.frombuffer(rows, np.int16)
            d = np.frombuffer(change, np.float32).reshape(len(at), -1)
            if total is None:
                total = np.zeros((cfg.block_rows, d.shape[1]), np.float32)
            total[at] += d
            hits[at] += np.frombuffer(times, np.int32)
        at = np.flatnonzero(hits)
        return pa.Table.from_batches([common.arrow_batch(
            schema, block=[table.column("block")[0].as_py()], task=[table.column("task")[0].as_py()],
            rows=[at.astype(np.int16).tobytes()], hits=[hits[at].tobytes()], change=[total[at].tobytes()])])
    return run


def summed(changes: DataFrame, tasks: int, cfg: Settings) -> DataFrame:
    """Sums over all tasks by a tree in which at most FAN_IN rows meet."""
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        changes = (changes.withColumn("task", (F.col("task") % tasks).cast("int"))
                   .groupBy("block", "task").applyInArrow(_combine(cfg), CHANGES))
    return changes


def count_tokens(train: DataFrame, cfg: Settings) -> DataFrame:
    """Training tokens: hash, tail class, count."""
    return (train.select("text").mapInArrow(_count(cfg), COUNTS)
            .groupBy("h").agg(F.min("tail").alias("tail"), F.sum("c").alias("c")))


def initial(counts: DataFrame, cfg: Settings) -> Model:
    """Biases and broadcast counts from the counts of all training tokens."""
    size = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = int(size["n"] or 0), int(size["v"])
    # at most broadcast_words rows: each holds that share of the tokens or more
    known = counts.filter(F.col("c") * cfg.broadcast_words >= total).select("h", "c").toArrow()
    kh, kc = known.column("h").to_numpy().view(U64), known.column("c").to_numpy()
    order = np.argsort(kh)
    kh, kc = kh[order], kc[order]
    room = cfg.head_classes * cfg.slots
    top = counts.filter(F.col("h") != int(END.view(np.int64))).orderBy(F.desc("c"), "h").limit(room - 1).collect()
    ends = counts.filter(F.col("h") == int(END.view(np.int64))).agg(F.sum("c")).first()[0] or 0
    words = sorted([(float(r["c"]), r["h"]) for r in top] + [(max(float(ends), 0.5), int(END.view(np.int64)))],
                   key=lambda x: (-x[0], x[1]))
    head = np.array([w[1] for w in words], dtype=np.int64).view(U64)
    freq = np.array([w[0] for w in words])
    order = np.argsort(head)
    tail = np.ones(cfg.tail_classes)
    rest = counts.filter(~F.col("h").isin([w[1] for w in words])).groupBy("tail").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    for r in rest:
        tail[r["tail"]] = r["n"] + r["v"] + 1
    inner_bias = np.full((cfg.head_classes, cfg.slots), -1e4, np.float32)
    inner_bias.ravel()[:len(freq)] = np.log(freq)
    mass = np.full(cfg.classes, np.exp(-80.0))
    by_class = np.add.reduceat(freq, np.arange(0, len(freq), cfg.slots))
    mass[:len(by_class)] = by_class
    mass[cfg.head_classes:] = tail
    outer = np.zeros((cfg.class_rows, cfg.classes), np.float32)
    outer[0] = np.log(mass / mass.sum())
    # classes without a word get no mass in any history
    outer[0][len(by_class):cfg.head_classes] = -1e4
    return Model(cfg, total, distinct, head[order], np.arange(len(head))[order], np.log10(tail), kh, kc,
                 outer, inner_bias, np.zeros((cfg.inner_rows, cfg.slots), np.float32))


def train(docs: DataFrame, counts: DataFrame, total_bytes: int, cfg: Settings) -> Model:
    """Distributed gradient updates over all training rows, one part a round."""
    model = initial(counts, cfg)
    rows = docs.filter(~held_out()).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(cfg.rounds)))
    tasks = common.n_partitions(total_bytes, cfg.task_bytes, 4)
    blocks = -(-cfg.class_rows // cfg.block_rows)
    for k in range(cfg.rounds):
        part = rows.filter(F.col("part") == k).select("text").coalesce(tasks)
        changes = summed(part.mapInArrow(_train(model), CHANGES), tasks, cfg)
        outer, inner = model.outer.copy(), model.inner.copy()
        for r in changes.collect():             # one row per block of the fixed-size tables
            at = np.frombuffer(r["rows"], np.int16).astype(np.int64)
            d = np.frombuffer(r["change"], np.float32).reshape(len(at), -1)
            d = d / np.frombuffer(r["hits"], np.int32)[:, None]
            if r["block"] < blocks:
                outer[r["block"] * cfg.block_rows + at] += d
            else:
                inner[(r["block"] - blocks) * cfg.block_rows + at] += d
        model = Model(**{**model.__dict__, "outer": outer, "inner": inner})
    return model


def _score(model: Model):
    """Per row: all but the counts of words outside the broadcast ones, which
    follow as rows of their own."""
    schema = common.arrow_schema(PARTIAL)
    cfg = model.cfg
    heads = cfg.head_classes * cfg.slots
    base_mass = np.log10(model.train_tokens + model.distinct + 1)

    def run(batches):
        for b in common.bounded(batches):
            h, t, doc, _ = token_stream(b.column("text"), cfg.tail_classes)
            n = b.num_rows
            sym = model.symbols(h, t)
            outer, inner, cls = model.history(sym, doc)
            logp = np.zeros(len(sym))
            for k in range(0, len(sym), PIECE):
                part = slice(k, min(k + PIECE, len(sym)))
                c = cls[part]
                lp = _log_chosen(model.class_logits(outer[:, part]), c).astype(float)
                at = np.flatnonzero(sym[part] < heads)
                if len(at):
                    lp[at] += _log_chosen(model.slot_logits(inner[:, part][:, at], c[at]), sym[part][at] % cfg.slots)
                logp[part] = lp
            logp /= np.log(10)
            in_tail = sym >= heads
            logp[in_tail] -= model.tail_log[sym[in_tail] - heads]
            # counts of the broadcast words
            seen = np.zeros(len(h), dtype=bool)
            lg = np.zeros(len(h))
            if len(model.known):
                at = np.minimum(np.searchsorted(model.known, h), len(model.known) - 1)
                seen = model.known[at] == h
                lg[seen] = np.log10(model.known_count[at[seen]] + 1.0)
            known = np.bincount(doc, weights=seen, minlength=n).astype(np.int64)
            base = np.bincount(doc, weights=lg - base_mass, minlength=n)
            score = np.bincount(doc, weights=logp + np.where(in_tail, lg, 0.0), minlength=n)
            row = b.column("row").to_numpy()
            # the rest: one row per (document, word); head words outside the
            # broadcast ones are no tail words, so their counts only add to the base
            miss = np.flatnonzero(~seen)
            key = common.mix64(h[miss] ^ common.mix64(doc[miss].astype(U64)))
            _, first, times = np.unique(key, return_index=True, return_counts=True)
            m, d = miss[first], doc[miss[first]]
            yield common.arrow_batch(
                schema,
                row=np.concatenate([row, row[d]]),
                doc_id=pa.concat_arrays([b.column("doc_id"), pa.nulls(len(m), pa.int64())]),
                held_out=pa.concat_arrays([b.column("held_out"), pa.nulls(len(m), pa.bool_())]),
                # a document's own row has no word: a key of its own keeps these rows spread
                h=np.concatenate([common.mix64(row.astype(U64) + U64(0x5DEECE66D)).view(np.int64),
                                  h[m].view(np.int64)]),
                n=np.concatenate([np.zeros(n, np.int64), np.where(in_tail[m], times, -times)]),
                n_tokens=np.concatenate([np.bincount(doc, minlength=n), np.zeros(len(m), np.int64)]),
                n_known=np.concatenate([known, np.zeros(len(m), np.int64)]),
                base=np.concatenate([base, np.zeros(len(m))]), score=np.concatenate([score, np.zeros(len(m))]))
    return run


def scores(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (columns row, doc_id, held_out, text)."""
    parts = docs.mapInArrow(_score(model), PARTIAL)
    rare = counts.select("h", "c")
    times = F.abs("n")
    lg = F.coalesce(F.log10(F.col("c") + 1.0), F.lit(0.0)) * times
    joined = parts.join(rare, "h", "left").select(
        "row", "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.when(F.col("c").isNotNull(), times).otherwise(0)).alias("n_known"),
        (F.col("base") + lg).alias("base"),
        (F.col("score") + F.when(F.col("n") > 0, lg).otherwise(0.0)).alias("score"))
    return (joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.lit(model.train_tokens).cast("bigint").alias("train_tokens"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score")).drop("row"))


def lm_scores(docs: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    cfg = cfg or Settings()
    common.arrow_rows(docs.sparkSession)
    rows = common.id_and_text(docs)
    total = rows.agg(F.sum(F.octet_length("text") + F.lit(1))).first()[0] or 0
    counts = common.saved(count_tokens(rows.filter(~held_out()), cfg), "token-counts")
    model = train(rows, counts, total, cfg)
    keyed = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out().alias("held_out"), "text")
    return scores(keyed, model, counts)
