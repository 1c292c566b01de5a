"""Operator 2, quality classifier: a factorisation machine.

Inputs of a score are hashed lower-cased words, binned structure statistics
of the text and its length as metadata; labels, language, source and id are
never inputs.  With x the sparse input and v its factors, the pairwise part is
``1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``: linear in the number of
inputs.  The machine is fitted on a bounded sample of labelled rows
(``rows_per_class`` of each class, ``byte_budget`` bytes of whole texts) with
AdaGrad; its few megabytes of parameters go to the executors and every text is
scored where it is read, without a shuffle.

Defined results: null or empty text is scored on its structure alone; without
labelled rows every score is 0.5; repeated rows and extra columns change
nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, labelled
from .common import U64

#: Statistics and their number of bins.
STATS, BINS = 13, 16


@dataclass
class Settings:
    word_buckets: int = 1 << 16
    factors: int = 8
    rows_per_class: int = 2500
    byte_budget: int = 12 << 20
    calibration: int = 4            # each so manieth row of the sample calibrates the scores
    epochs: int = 8
    batch: int = 128
    rate: float = 0.08
    l2: float = 2e-5
    seed: int = 7


def _sums(x: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.zeros(len(x) + 1)
    np.cumsum(x, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def structure(data: np.ndarray, offs: np.ndarray, s, e, doc, h) -> np.ndarray:
    """Bin numbers (documents x STATS)."""
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1).astype(float)
    words = np.bincount(doc, minlength=n).astype(float)
    some = np.maximum(words, 1)
    upper = _sums((data >= 65) & (data <= 90), offs)
    lower = _sums((data >= 97) & (data <= 122), offs)
    digit = _sums((data >= 48) & (data <= 57), offs)
    line = _sums(data == 10, offs)
    mark = _sums((data < 128) & (data > 32) & ~((data >= 48) & (data <= 57)) & ~((data >= 65) & (data <= 90))
                 & ~((data >= 97) & (data <= 122)), offs)
    plain = _sums(np.isin(data, np.frombuffer(b".,;:'\"-()", np.uint8)), offs)
    high = _sums(data >= 128, offs)
    again = np.zeros(len(h))
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    repeats = np.bincount(doc, weights=again, minlength=n) if len(h) else np.zeros(n)
    distinct = np.zeros(n)
    if len(h):
        key = np.unique(common.mix64(h + doc.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]
        distinct = np.bincount(doc[key], minlength=n)
    short = np.bincount(doc, weights=(e - s) <= 1, minlength=n) if len(h) else np.zeros(n)
    ratio = lambda a, b: np.minimum(np.floor(np.sqrt(a / b) * BINS), BINS - 1)
    logs = lambda a: np.minimum(np.floor(np.log2(1 + a)), BINS - 1)
    return np.stack([
        logs(size), logs(words), logs(line), np.minimum(np.floor(size / some), BINS - 1),
        ratio(upper, upper + lower + 1), ratio(digit, size), ratio(mark, size), ratio(np.maximum(mark - plain, 0), size),
        ratio(high, size), ratio(repeats, some), ratio(distinct, some), ratio(short, some), ratio(words, size),
    ], axis=1).astype(np.int64)


def inputs(data: np.ndarray, offs: np.ndarray, cfg: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: pointer (n + 1), input numbers, values."""
    n = len(offs) - 1
    s, e, doc = common.word_ranges(data, offs)
    h = common.range_hashes(data, s, e)
    bins = structure(data, offs, s, e, doc, h)
    cell = doc * cfg.word_buckets + (h % U64(cfg.word_buckets)).astype(np.int64)
    cell, count = np.unique(cell, return_counts=True)
    wd, wi = cell // cfg.word_buckets, cell % cfg.word_buckets
    wv = 1 + np.log(count)
    norm = np.sqrt(np.bincount(wd, weights=wv * wv, minlength=n))
    wv = wv / np.maximum(norm, 1e-9)[wd]
    sd = np.repeat(np.arange(n), STATS)
    si = cfg.word_buckets + (bins + np.arange(STATS) * BINS).ravel()
    d = np.concatenate([wd, sd])
    order = np.argsort(d, kind="stable")
    ptr = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.bincount(d, minlength=n), out=ptr[1:])
    return ptr, np.concatenate([wi, si])[order].astype(np.int32), \
        np.concatenate([wv, np.full(len(sd), STATS ** -0.5)])[order].astype(np.float32)


@dataclass
class Machine:
    cfg: Settings
    bias: float
    w: np.ndarray
    v: np.ndarray
    scale: float = 1.0
    offset: float = 0.0

    def raw(self, ptr, idx, val):
        """Scores before the logistic function, and the factor sums."""
        rows = ptr[:-1]
        vx = self.v[idx] * val[:, None]
        s = np.add.reduceat(vx, rows, axis=0)
        pair = 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), rows))
        return self.bias + np.add.reduceat(self.w[idx] * val, rows) + pair, s

    def score_texts(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        data, offs = common.buffers(texts)
        z, _ = self.raw(*inputs(data, offs, self.cfg))
        z = self.scale * z + self.offset
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))

    def score(self, text: Column) -> Column:
        """Score column (0 to 1, higher: label 1 likelier) of a text column."""
        machine = self

        @F.pandas_udf("double")
        def fm_score(t: pd.Series) -> pd.Series:
            scores = machine.score_texts(pa.array(t, type=pa.string(), from_pandas=True))
            common.give_back()
            return pd.Series(scores)
        return fm_score(F.coalesce(text, F.lit("")))


def fit(texts: pa.Array, labels: np.ndarray, cfg: Settings) -> Machine:
    """AdaGrad on the logistic loss over mini-batches."""
    rng = np.random.default_rng(cfg.seed)
    size = cfg.word_buckets + STATS * BINS
    m = Machine(cfg, 0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, cfg.factors)).astype(np.float32))
    if not len(labels):
        m.v[:] = 0
        return m
    parts = []
    for k in range(0, len(labels), cfg.batch):      # texts stay in their given hash order inside a part
        data, offs = common.buffers(texts.slice(k, cfg.batch))
        parts.append((*inputs(data, offs, cfg), labels[k:k + cfg.batch].astype(np.float32)))
    share = min(max(float(labels.mean()), 0.01), 0.99)
    m.bias = float(np.log(share / (1 - share)))
    gb, gw, gv = 1e-6, np.full(size, 1e-6, np.float32), np.full(m.v.shape, 1e-6, np.float32)
    for _ in range(cfg.epochs):
        for p in rng.permutation(len(parts)):
            ptr, idx, val, y = parts[p]
            z, s = m.raw(ptr, idx, val)
            err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)
            row = np.repeat(np.arange(len(y)), np.diff(ptr))
            u, inv = np.unique(idx, return_inverse=True)
            ev = err[row] * val
            dw = np.bincount(inv, weights=ev, minlength=len(u)) + cfg.l2 * m.w[u]
            dv = np.stack([np.bincount(inv, weights=ev * (s[row, f] - m.v[idx, f] * val), minlength=len(u))
                           for f in range(cfg.factors)], axis=1) + cfg.l2 * m.v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            m.w[u] -= cfg.rate * dw / np.sqrt(gw[u])
            m.v[u] -= cfg.rate * 0.25 * dv / np.sqrt(gv[u])
            db = float(err.sum())
            gb += db * db
            m.bias -= cfg.rate * db / gb ** 0.5
    return m


def train(docs: DataFrame, labels: DataFrame, cfg: Settings | None = None) -> Machine:
    """Fit on the bounded labelled sample of ``docs``."""
    cfg = cfg or Settings()
    common.arrow_rows(docs.sparkSession)
    sample, shift = labelled.sample_texts(docs, labels, "quality", cfg.rows_per_class, cfg.byte_budget)
    texts, y = sample.column("text").combine_chunks(), sample.column("label").to_numpy().astype(float)
    own = np.arange(len(y)) % cfg.calibration == 0
    model = fit(texts.filter(pa.array(~own)), y[~own], cfg)
    calibrate(model, texts.filter(pa.array(own)), y[own], shift)
    return model


def calibrate(model: Machine, texts: pa.Array, y: np.ndarray, shift: float) -> None:
    """Logistic fit of the labels on the raw scores of rows the machine has not
    seen, each class weighted by its share among all training labels."""
    if not 0 < y.sum() < len(y):
        return
    z = np.concatenate([model.raw(*inputs(*common.buffers(texts.slice(k, model.cfg.batch)), model.cfg))[0]
                        for k in range(0, len(y), model.cfg.batch)])
    x = np.stack([z.astype(float), np.ones(len(z))], axis=1)
    weight = np.where(y == 1, np.exp(shift / 2), np.exp(-shift / 2))
    b, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        b = b - np.linalg.solve(hess, x.T @ (weight * (p - y)) + 0.1 * (b - prior))
    if np.isfinite(b).all() and b[0] > 0:
        model.scale, model.offset = float(b[0]), float(b[1])


def scores(docs: DataFrame, model: Machine) -> DataFrame:
    rows = common.id_and_text(docs)
    return (rows.select("doc_id", labelled.held_out().alias("held_out"), model.score(F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
