"""Pairs at the threshold, compared by too few bits first; groups of every size."""

import random

import pytest

from pathsift.llm import jaccard_join as jj

DOCS = "doc_id bigint, text string"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), d), d)
    return {d: (len(sets[k]), least[root(k)]) for k, (d, _) in enumerate(rows)}


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.components(df, jj.Settings(**kw)).collect()}


def test_very_long_texts_one_shingle_about_the_threshold(spark):
    """100,000 shingles; 75 % exactly, and one shingle less."""
    n = 100_000
    base = [f"w{k}" for k in range(n + 4)]
    common = n * 6 // 7                                   # |a & b| = 6/7 n, |a | b| = 8/7 n: exactly 75 %
    while 100 * common < 75 * (2 * n - common):
        common += 1
    rows = [(1, " ".join(base))]
    for d, c in ((2, common), (3, common - 1)):
        rows.append((d, " ".join(base[:c + 4] + [f"x{d}-{k}" for k in range(n - c)])))
    out = got(spark, rows)
    assert out == {1: (n, 1), 2: (n, 1), 3: (n, 3)}


@pytest.mark.parametrize("seed", [1, 2])
def test_small_vocabulary_against_brute_force(spark, seed):
    """Texts of few words share many n-grams; groups of all sizes, near and far."""
    rnd = random.Random(seed)
    vocab = [f"v{k}" for k in range(40)]
    rows = []
    for d in range(60):
        if rows and rnd.random() < 0.6:
            w = rnd.choice(rows)[1].split()
            for _ in range(rnd.randrange(5)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        else:
            w = rnd.choices(vocab, k=rnd.choice([4, 5, 6, 30, 120]))
        rows.append((d, " ".join(w)))
    assert got(spark, rows) == classes(rows)


def test_parities_never_exceed_the_difference():
    import numpy as np
    rnd = np.random.default_rng(1)
    for _ in range(200):
        both, a, b = (rnd.integers(0, 2 ** 63, k, dtype=np.uint64) for k in rnd.integers(0, [900, 200, 200]))
        sets = [np.unique(np.concatenate([both, x])) for x in (a, b)]
        g, d = np.concatenate(sets), np.repeat([0, 1], [len(x) for x in sets])
        pa, pb = jj.parities_of(g, d, 2)
        differ = sum(int(x).bit_count() for x in (pa ^ pb).view(np.uint64))
        assert differ <= len(np.setxor1d(*sets))
        if len(a) + len(b) > 150:
            assert differ > 60
