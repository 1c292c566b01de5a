import random
import statistics

import pytest
from pyspark.sql import functions as F

from pathsift.functions.editdistance import levenshtein
from pathsift.operators import paths


def _items(spark, rows):
    return spark.createDataFrame(rows, "domain string, seq int, path string, item string")


def test_ratio_against_sentinel(spark):
    r = paths.path_ratios(_items(spark, [("d", 1, "/p", "aa")])).first()
    assert r.ratio == pytest.approx(2 * 5 / 7)
    r2 = paths.path_ratios(_items(spark, [("d", 1, "/p", "aa"), ("d", 1, "/p", "bb")])).first()
    assert r2.ratio == pytest.approx(2 * 5 / 7 / 2)
    r1 = paths.path_ratios(_items(spark, [("d", 1, "/p", "aa"), ("d", 1, "/p", "bb")]), normalized=False).first()
    assert r1.ratio == pytest.approx(2 * 5 / 7)


def test_background_starts_at_first_seen(spark):
    # path first seen on page 2: page 2 only sees 'empty', page 3 sees page 2's item
    rows = [("d", 2, "/p", "abc"), ("d", 3, "/p", "abd")]
    out = {r.seq: r.ratio for r in paths.path_ratios(_items(spark, rows)).collect()}
    assert out[2] == pytest.approx(2 * levenshtein("abc", "empty") / 8)
    d_empty = 2 * levenshtein("abd", "empty") / 8
    d_prev = 2 * 1 / 6
    assert out[3] == pytest.approx(statistics.median([d_empty, d_prev]))


def _split(spark, values):
    df = spark.createDataFrame([("d", 1, f"/p{i}", float(v)) for i, v in enumerate(values)],
                               "domain string, seq int, path string, ratio double")
    return {r.path: r.is_content for r in paths.content_paths(df).collect()}


def test_two_means_split(spark):
    m = _split(spark, [0, 0.1, 0.9, 1])
    assert [m[f"/p{i}"] for i in range(4)] == [False, False, True, True]
    assert all(_split(spark, [0.5, 0.5, 0.5]).values())
    assert _split(spark, [0.3]) == {}


def _sequential(pages):
    """Loop form of the trainer for one domain: pages = list of {path: [items]}."""
    bg, out = {}, {}
    cands = []
    for k, page in enumerate(pages, 1):
        for p in page:
            if p not in cands:
                cands.append(p)
        for p in cands:
            bg.setdefault(p, ["empty"])
            items = sorted(set(page.get(p, ["empty"])))
            meds = [statistics.median([levenshtein(a, b) * 2 / (len(a) + len(b)) / len(items) for b in bg[p]])
                    for a in items]
            out[(p, k)] = statistics.mean(meds)
            bg[p] = bg[p] + items
    return out


def test_loop_equivalence(spark):
    rnd = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "news", "menu", "home", "x"]
    rows, expect = [], {}
    for d in range(4):
        pages = []
        for _ in range(rnd.randint(1, 5)):
            page = {}
            for p in ["/a", "/b", "/c"]:
                if rnd.random() < 0.8:
                    page[p] = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))
                               for _ in range(rnd.randint(1, 2))]
            pages.append(page)
        first = {}
        for k, page in enumerate(pages, 1):
            for p in page:
                first.setdefault(p, k)
        for k, page in enumerate(pages, 1):
            for p, f in first.items():
                if k >= f:
                    for it in set(page.get(p, ["empty"])):
                        rows.append((f"d{d}", k, p, it))
        for (p, k), v in _sequential(pages).items():
            expect[(f"d{d}", p, k)] = v
    got = {(r.domain, r.path, r.seq): r.ratio for r in paths.path_ratios(_items(spark, rows)).collect()}
    assert set(got) == set(expect)
    for key, v in expect.items():
        assert got[key] == pytest.approx(v, abs=1e-12)
