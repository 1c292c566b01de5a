"""The kernels of operator 5 give the values of their plain forms, bit by bit."""

import numpy as np

from pathsift.llm import common, maxent_lm


def test_row_sums_and_chosen_scores():
    r = np.random.default_rng(3)
    for n, distinct in ((1, 1), (50, 60), (5000, 900), (5000, 7)):
        rows, err = r.integers(0, distinct, n), r.standard_normal((n, 64)).astype(np.float32)
        order = np.argsort(rows, kind="stable")
        u, first = np.unique(rows[order], return_index=True)
        got, sums = maxent_lm._row_sums(rows, err)
        assert np.array_equal(got, u) and np.array_equal(sums, np.add.reduceat(err[order], first, axis=0))
        at = r.integers(0, 64, n)
        want = maxent_lm._log_softmax(err.copy())
        assert np.array_equal(maxent_lm._log_chosen(err.copy(), at), want[np.arange(n), at])
        assert np.array_equal(maxent_lm._probabilities(lambda p: err[p].copy(), n, 64), np.exp(want))


def test_hashes_share_their_sums():
    data = np.frombuffer("Some words, SOME words".encode(), np.uint8)
    s, e = np.array([0, 5, 12]), np.array([4, 10, 16])
    h = common.range_hashes(data, s, e, sums=common.prefix_sums(data))
    assert np.array_equal(h, common.range_hashes(data, s, e)) and h[0] == h[2] != h[1]
