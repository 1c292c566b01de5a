"""Operator 12: the index's cells and the ranking against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pathsift.llm import common
from pathsift.llm import treap_search as t

DOCS = "doc_id bigint, text string, score string, item_id bigint"
ITEMS = "item_id bigint, text string, doc_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    bags = [(i, Counter(words(x))) for i, x, *_ in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    total, length = len(bags), sum(n for *_, n in bags)
    df = Counter(w for _, b, _ in bags for w in b)
    asked = {}
    for i, x, *_ in items:
        asked.setdefault(i, set()).update(words(x))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, bag, n in bags:
            m = 100 - 90 + (90 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1)))
                        * ((10 ** 9 * bag[w]) // (1000 * bag[w] + 8 * m)) for w in terms if w in bag)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def held_to(spark, tmp_path, docs, items, cfg=None):
    index = t.build_index(spark.createDataFrame(docs, DOCS).repartition(3), str(tmp_path / "index"), cfg)
    got = t.search(index, spark.createDataFrame(items, ITEMS), cfg).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(docs, items, cfg.k if cfg else 10)
    return index


def corpus(n=260, seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["Élan", "élan", "naïve", "日本", "A-B", "x_y", "Iİ"]
    weight = [1 / (k + 1) for k in range(len(vocab))]
    docs = [(rnd.choice([None, k, k // 3]), " ".join(rnd.choices(vocab, weight, k=rnd.choice([1, 5, 40, 300]))), "s", 1)
            for k in range(n)]
    docs += [(k, "w1 w2 w250 copies", "s", 1) for k in range(900, 980)] + [(5, t, "s", 1) for t in (None, "", " \n.,", "z " * 700)]
    docs += [(2000, "w3 " * 90_000 + "w299", "s", 1), (2001, "w3 " * 400 + "w4", "s", 1)]
    items = [(k, " ".join(rnd.choices(vocab, k=rnd.choice([1, 4, 30]))), "d") for k in range(25)]
    items += [(None, "w1 w2"), (None, "w250"), (100, "copies w1"), (101, None), (102, ""), (103, "unheard of"),
              (104, " ".join(vocab)), (105, "z w3 W3"), (105, "naïve")]
    return docs, [(*i, "d")[:3] for i in items]


@pytest.mark.parametrize("cfg", [None, t.Settings(block_docs=16, beam=1, pairs=20, lanes=40),
                                 t.Settings(block_bytes=3000, beam=3, k=3)])
def test_ranking_against_brute_force(spark, tmp_path, cfg):
    held_to(spark, tmp_path, *corpus(), cfg)


def test_no_documents_no_items(spark, tmp_path):
    docs, items = corpus()
    held_to(spark, tmp_path / "a", [], items)
    held_to(spark, tmp_path / "b", [(1, None, "", 1), (2, "...", "", 1)], items)
    held_to(spark, tmp_path / "c", docs[:5], [])
    held_to(spark, tmp_path / "d", [(3, "one", "", 1)], [(1, "one", "")])


def test_cells_bound_their_points():
    rnd = np.random.default_rng(2)
    text = [" ".join(f"t{int(x)}" for x in rnd.zipf(1.3, size=60) % 500) for _ in range(70)]
    data = np.frombuffer("".join(text).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(x) for x in text])])
    row = t.block_row(data, offs, np.arange(70)[::-1].copy(), np.zeros(70, bool), 70, 4200)
    treap = t.Treap(row)
    assert list(treap.ids) == list(range(70))
    vocab = {int(h): int(r) for h, r in zip(treap.vocab, treap.rows, strict=True)}
    for d, x in enumerate(text):
        col = 69 - d
        for w, tf in Counter(x.split()).items():
            h = common.range_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]
            line, cell, last = vocab[int(h)], np.array([0]), 10 ** 7
            exact = int(t.impacts(np.array([tf]), treap.norms[col])[0])
            for level in range(treap.height):
                shift = treap.height - 1 - level
                cell = list(treap.children(level, cell, np.array([line >> shift & 1], np.uint8)))[col >> shift & 1]
                top = int(np.ravel(treap.bound(level + 1, cell[None] if level + 1 == treap.height else cell, np.array([col])))[0])
                assert cell[0] >= 0 and exact <= top <= last
                last = top
            assert last == exact
