"""Operator 10, toxicity: a linear-chain conditional random field over tokens.

Tokens are runs of letters and digits (any byte from 0x80 counts as a letter).
The chain has two states, clean and toxic; its emission is the sum of hashed
features (word, byte prefixes and suffix, neighbours, case), its transitions
are learned.  A chain covers a whole line of the text, however long.

Labelled tokens for training come from the labelled documents: a token of a
toxic document is toxic when its word or a prefix of it is far more frequent
in toxic than in other documents of the sample.  Fitting maximises the
conditional likelihood (forward-backward gradients, AdaGrad) on the bounded
sample (``rows_per_class``, ``byte_budget``).  Scoring runs forward-backward
where the text is read; a logistic function of the marginals' aggregates,
fitted on the same sample, gives the document score, and runs of tokens with
marginals of 0.5 or more give the offending offsets (code points).

Defined results: null or empty text has no tokens, the score of its intercept
and no spans; without labelled rows every score is 0; repeated rows and extra
columns change nothing.  Words mark toxic documents from ``min_docs`` of them on:
fewer labelled toxic documents in the sample tag no token.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, labelled
from .common import U64

OUT = "doc_id bigint, score double, spans array<struct<start:int,stop:int,marginal:double>>"
PREFIXES = (4, 5, 6, 7)
FEATURES = 2 + len(PREFIXES) * 2 + 2
DOC_FEATURES = 4

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[128:] = _TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = True


@dataclass
class Settings:
    buckets: int = 1 << 18
    rows_per_class: int = 1000
    byte_budget: int = 3 << 20
    rounds: int = 20
    rate: float = 0.5
    l2: float = 1e-4
    min_docs: int = 5
    min_odds: float = 3.5


def tokens(data: np.ndarray, offs: np.ndarray):
    """Starts, ends and documents of the tokens."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = _TOKEN[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offs] = True
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    stop[:-1] &= ~inside[1:] | first[1:-1]
    s = np.flatnonzero(begin)
    return s, np.flatnonzero(stop) + 1, common.doc_of(offs, s)


def _prefix_hashes(data, s, e) -> list[np.ndarray]:
    out = []
    for k, n in enumerate(PREFIXES):
        h = common.range_hashes(data, s, np.minimum(s + n, e)) + U64(k + 1)
        h[e - s < n] = 0            # too short for this prefix
        out.append(h)
    return out


def chains(data, offs, s, doc) -> np.ndarray:
    """First token of each chain: a new document or line."""
    if not len(s):
        return np.zeros(0, np.int64)
    lines = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(data == 10, out=lines[1:])
    new = np.ones(len(s), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lines[s[1:]] != lines[s[:-1]])
    return np.flatnonzero(new)


def features(data, s, e, first, buckets: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Feature numbers (tokens x FEATURES), the word hashes, prefix hashes."""
    word = common.range_hashes(data, s, e)
    prefixes = _prefix_hashes(data, s, e)
    n = len(s)
    starts = np.zeros(n + 1, dtype=bool)
    starts[first] = True
    starts[n] = True

    def shifted(h, back):
        out = np.zeros(n, U64)
        if back:
            out[1:] = np.where(starts[1:n], U64(0), h[:-1])
        else:
            out[:-1] = np.where(starts[1:n], U64(0), h[1:])
        return out

    suffix = common.range_hashes(data, np.maximum(e - 4, s), e)
    shape = (data[s].astype(U64) >> U64(5)) + U64(8) * np.minimum(e - s, 12).astype(U64)
    near = prefixes[1]
    rows = [word, *prefixes, suffix, shape, shifted(word, True), shifted(word, False),
            shifted(near, True), shifted(near, False)]
    rows = rows[:FEATURES]
    out = np.empty((n, len(rows)), dtype=np.int32)
    for k, h in enumerate(rows):
        out[:, k] = (common.mix64(h + U64(0x51ED270B9F * (k + 1))) % U64(buckets)).astype(np.int32)
    return out, word, prefixes


class Chains:
    """Chains of a batch laid out for vectorised recursions over time."""

    def __init__(self, first: np.ndarray, n: int):
        size = np.diff(np.append(first, n))
        order = np.argsort(-size, kind="stable")
        self.start, self.size = first[order], size[order]
        steps = int(size.max()) if len(size) else 0
        self.live = np.searchsorted(-self.size, -np.arange(steps), side="left")   # chains longer than t

    def marginals(self, emit: np.ndarray, trans: np.ndarray):
        """P(toxic) per token, pair sums (2 x 2) and the log likelihood base.

        ``emit``: score of toxic against clean; ``trans[a, b]``: from a to b."""
        n = len(emit)
        up = np.exp(np.clip(emit, -30, 30))
        t = np.exp(trans)
        a0, a1, scale = np.empty(n), np.empty(n), np.empty(n)
        b0, b1 = np.ones(n), np.ones(n)
        for k, live in enumerate(self.live):
            at = self.start[:live] + k
            if k == 0:
                x0, x1 = np.ones(live), up[at]
            else:
                p = at - 1
                x0 = a0[p] * t[0, 0] + a1[p] * t[1, 0]
                x1 = (a0[p] * t[0, 1] + a1[p] * t[1, 1]) * up[at]
            c = x0 + x1
            a0[at], a1[at], scale[at] = x0 / c, x1 / c, c
        pairs = np.zeros((2, 2))
        for k in range(len(self.live) - 1, 0, -1):
            at = self.start[:self.live[k]] + k
            p = at - 1
            n0, n1 = b0[at] / scale[at], up[at] * b1[at] / scale[at]
            pairs[0, 0] += (a0[p] * n0).sum() * t[0, 0]
            pairs[0, 1] += (a0[p] * n1).sum() * t[0, 1]
            pairs[1, 0] += (a1[p] * n0).sum() * t[1, 0]
            pairs[1, 1] += (a1[p] * n1).sum() * t[1, 1]
            b0[p], b1[p] = t[0, 0] * n0 + t[0, 1] * n1, t[1, 0] * n0 + t[1, 1] * n1
        g0, g1 = a0 * b0, a1 * b1
        return g1 / (g0 + g1), pairs, float(np.log(scale).sum())


def _document_inputs(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Aggregates of the marginals: intercept, log of their sum, the largest,
    the share of a clean document by noisy-or over clear hits."""
    total, top, hits = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(p):
        total = np.bincount(doc, weights=np.where(p > 0.05, p, 0), minlength=n)
        np.maximum.at(top, doc, p)
        hits = np.bincount(doc, weights=p >= 0.5, minlength=n)
    return np.stack([np.ones(n), np.log1p(total), top, np.minimum(hits, 4) / 4], axis=1)


@dataclass
class Tagger:
    cfg: Settings
    weights: np.ndarray
    trans: np.ndarray
    doc_weights: np.ndarray

    def tag(self, data, offs):
        s, e, doc = tokens(data, offs)
        first = chains(data, offs, s, doc)
        p = np.zeros(0)
        if len(s):
            x, _, _ = features(data, s, e, first, self.cfg.buckets)
            p = Chains(first, len(s)).marginals(self.weights[x].sum(axis=1), self.trans)[0]
        return s, e, doc, first, p

    def score(self, p, doc, n):
        z = _document_inputs(p, doc, n) @ self.doc_weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _token_labels(word, prefixes, doc, toxic, cfg: Settings) -> np.ndarray:
    """Distant labels: words and prefixes that mark toxic documents."""
    n1, n0 = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    out = np.zeros(len(word), dtype=bool)
    for h in (word, *prefixes):
        u, inv = np.unique(h, return_inverse=True)
        pair = np.unique(inv * len(toxic) + doc)
        f, d = pair // len(toxic), pair % len(toxic)
        c1 = np.bincount(f, weights=toxic[d], minlength=len(u))
        c0 = np.bincount(f, weights=~toxic[d], minlength=len(u))
        odds = np.log((c1 + 0.5) / n1) - np.log((c0 + 0.5) / n0)
        marks = (c1 >= cfg.min_docs) & (odds >= cfg.min_odds) & (u != 0)
        out |= marks[inv]
    return out & toxic[doc]


def fit(texts: pa.Array, labels: np.ndarray, cfg: Settings) -> Tagger:
    model = Tagger(cfg, np.zeros(cfg.buckets, np.float32), np.zeros((2, 2)), np.zeros(DOC_FEATURES))
    toxic = labels.astype(bool)
    model.doc_weights[0] = -30.0
    if not len(labels) or not toxic.any():
        return model
    data, offs = common.buffers(texts)
    s, e, doc = tokens(data, offs)
    first = chains(data, offs, s, doc)
    x, word, prefixes = features(data, s, e, first, cfg.buckets)
    y = _token_labels(word, prefixes, doc, toxic, cfg)
    # a toxic document without a marked token tells nothing about its tokens
    told = np.zeros(len(labels), dtype=bool)
    told[doc[y]] = True
    use = (told | ~toxic)[doc]
    new = np.zeros(len(s), dtype=bool)
    new[first] = True
    x, y, new = x[use], y[use].astype(float), new[use]
    firsts = np.flatnonzero(new)
    run = Chains(firsts, len(y))
    inner = ~new
    gold = np.zeros((2, 2))
    prev = np.flatnonzero(inner) - 1
    np.add.at(gold, (y[prev].astype(int), y[inner].astype(int)), 1)
    w, t = np.zeros(cfg.buckets), np.zeros((2, 2))
    t[:, 1] = -2.0
    gw, gt = np.full(cfg.buckets, 1e-4), np.full((2, 2), 1e-4)
    scale = max(y.sum(), 1.0)
    for _ in range(cfg.rounds):
        p, pairs, _ = run.marginals(w[x].sum(axis=1), t)
        miss = (p - y) / scale
        grad = np.zeros(cfg.buckets)
        for k in range(x.shape[1]):
            grad += np.bincount(x[:, k], weights=miss, minlength=cfg.buckets)
        grad += cfg.l2 * w / cfg.rounds
        gw += grad * grad
        w -= cfg.rate * grad / np.sqrt(gw)
        dt = (pairs - gold) / scale
        gt += dt * dt
        t -= cfg.rate * dt / np.sqrt(gt)
    model.weights, model.trans = w.astype(np.float32), t
    # document score: logistic regression on the aggregated marginals (Newton steps)
    _, _, doc, _, p = model.tag(data, offs)
    z = _document_inputs(p, doc, len(labels))
    b, ridge = np.zeros(DOC_FEATURES), np.eye(DOC_FEATURES) * 0.05
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + ridge, z.T @ (q - toxic) + ridge @ b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    model.doc_weights = b
    return model


def train(docs: DataFrame, labels: DataFrame, cfg: Settings | None = None) -> Tagger:
    cfg = cfg or Settings()
    common.arrow_rows(docs.sparkSession)
    sample, shift = labelled.sample_texts(docs, labels, "toxic", cfg.rows_per_class, cfg.byte_budget)
    model = fit(sample.column("text").combine_chunks(), sample.column("label").to_numpy().astype(int), cfg)
    model.doc_weights[0] += shift
    return model


def _score(model: Tagger):
    schema = common.arrow_schema(OUT)

    def run(batches):
        for b in common.bounded(batches):
            data, offs = common.buffers(b.column("text"))
            n = len(offs) - 1
            s, e, doc, first, p = model.tag(data, offs)
            spans: list[list] = [[] for _ in range(n)]
            hit = np.flatnonzero(p >= 0.5)
            if len(hit):
                lead = np.zeros(len(data) + 1, dtype=np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
                cut = np.zeros(len(s) + 1, dtype=bool)
                cut[first] = True
                runs = np.split(hit, np.flatnonzero((np.diff(hit) > 1) | cut[hit[1:]]) + 1)
                for r in runs:
                    d = doc[r[0]]
                    base = lead[offs[d]]
                    spans[d].append({"start": int(lead[s[r[0]]] - base), "stop": int(lead[e[r[-1]]] - base),
                                     "marginal": float(p[r].max())})
            yield common.arrow_batch(schema, doc_id=b.column("doc_id"), score=model.score(p, doc, n), spans=spans)
    return run


def scores(docs: DataFrame, model: Tagger) -> DataFrame:
    """doc_id, score and offending spans of every document."""
    common.arrow_rows(docs.sparkSession)
    return common.id_and_text(docs).mapInArrow(_score(model), OUT)
