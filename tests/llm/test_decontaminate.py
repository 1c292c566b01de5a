"""Operator 1: matches against all alignments, half quotes, several blocks."""

import random
import sys

import numpy as np
import pytest

from pathsift.llm import decontaminate as dc

DOCS, ITEMS = "doc_id bigint, text string, item_id string", "item_id bigint, text string, doc_id string"


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghiklmnoprstuvwz") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def edited(rnd, text, share):
    out = list(text)
    for _ in range(int(len(text) * share)):
        i = rnd.randrange(len(out))
        out[i:i + rnd.randrange(2)] = rnd.choice(["", "x", "q"])
    return "".join(out)


def least_edits(item, text):
    """Semi-global distance by the plain dynamic programme."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def kept(text):
    return "".join(c for c in (text or "").lower() if c.isascii() and c.isalnum() or ord(c) > 127).encode()


def test_band_gives_the_same_alignment():
    rnd = random.Random(2)
    for _ in range(200):
        item = words(rnd, 6).encode()
        text = (words(rnd, 4) + edited(rnd, item.decode(), rnd.choice([0, 0.05, 0.1])) + words(rnd, 4)).encode()
        x, t = np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8)
        full = dc.banded_alignment(x, t, 10)
        best = least_edits(item, text)
        assert (full[0] if full else None) == (best if best <= 10 else None)
        if full:
            edits, start, stop = full
            e = edits + 1
            assert dc.banded_alignment(x, t, 10, start - e, stop - len(item) + e)[0] == edits


@pytest.mark.parametrize("blocks", [1, 3])
def test_matches_against_all_alignments(spark, blocks):
    rnd = random.Random(blocks)
    items = [(k, words(rnd, n)) for k, n in enumerate([3, 8, 15, 20, 40])] + [(90, None), (91, "short"), (None, words(rnd, 12))]
    docs = []
    for k in range(60):
        text = words(rnd, rnd.randint(5, 60))
        if k % 3 == 0:
            text += " " + edited(rnd, rnd.choice([t for _, t in items if t]), rnd.choice([0, 0.04, 0.08, 0.15])) + " " + words(rnd, 9)
        docs.append((k if k % 10 else None, text))
    docs += [(200, None), (201, ""), (202, words(rnd, 30_000) + " " + items[3][1])]
    cfg = dc.Settings(block_bytes=(1 << 20) if blocks == 1 else 150)
    got = dc.matches(spark.createDataFrame([(*d, "c") for d in docs], DOCS), spark.createDataFrame([(*i, "c") for i in items], ITEMS), cfg)
    got = sorted((str(r["doc_id"]), str(r["item_id"]), r["piece"], r["edits"]) for r in got.collect())
    want = []
    for i, t in items:
        body = kept(t)
        if len(body) < cfg.q:
            continue
        if len(body) <= 150:
            spots = [(0, len(body))]
        else:
            spots = [(a, a + 100) for a in (*range(0, len(body) - 100, 50), len(body) - 100)]
        for j, (a, b) in enumerate(spots):
            part = body[a:b]
            budget = min(int(cfg.rate * len(part)), (len(part) - cfg.q) // cfg.q)
            for d, x in docs:
                text = kept(x)
                if len(text) > 20_000:
                    if part in text:
                        want.append((str(d), str(i), j, 0))
                elif (edits := least_edits(part, text)) <= budget:
                    want.append((str(d), str(i), j, edits))
    assert got == sorted(want)


def test_half_quotes_are_found(spark):
    """Of long items, quotes of half the text, with a few typing errors, anywhere in a document."""
    rnd = random.Random(7)
    items = [(k, words(rnd, rnd.randint(70, 160))) for k in range(40)]
    docs = [(k, words(rnd, 50) + " " + edited(rnd, t[a:a + len(t) // 2], 0.03) + " " + words(rnd, 50))
            for k, t in items for a in [rnd.randrange(len(t) // 2)]]
    docs += [(1000 + k, words(rnd, 200)) for k in range(40)]
    found = dc.matches(spark.createDataFrame([(*d, "c") for d in docs], DOCS), spark.createDataFrame([(*i, "c") for i in items], ITEMS))
    got = {(r["doc_id"], r["item_id"]): r["covered"] for r in dc.covered(found).collect()}
    assert all(d == i for d, i in got) and len(got) >= 36
    assert all(0.1 < c <= 0.75 for c in got.values())


def plain_band(item, text, limit, low, high):
    """(edits, start, stop) on the diagonals from low to high, cell by cell; ties
    as in the operator: no gap before a gap in the text, then the shortest
    run of added text characters; the leftmost best end."""
    m, n, far = len(item), len(text), 10 ** 6
    cost = {d: (0, d) if 0 <= d <= n else (far, d) for d in range(low, high + 1)}
    for k in range(m):
        new, before = {}, None
        for d in range(low, high + 1):
            j = d + k + 1
            cell = (far, 0)
            if 0 <= j <= n:
                sub = cost[d][0] + (text[j - 1] != item[k]) if j else far
                down = cost[d + 1][0] + 1 if d < high else 2 * far
                cell = (sub, cost[d][1]) if sub <= down else (down, cost[d + 1][1])
                if before and before[0] + 1 < cell[0]:
                    cell = (before[0] + 1, before[1])
            new[d] = before = cell
        cost = new
    edits, end = min((c[0], d) for d, c in cost.items())
    return (edits, cost[end][1], end + m) if edits <= limit else (-1, -1, -1)


@pytest.mark.parametrize("cells", [1, 300, 1 << 20])
def test_many_alignments_at_once_are_those_of_each(cells, monkeypatch):
    monkeypatch.setattr(dc, "CELLS", cells)
    rnd = random.Random(5)
    lanes = []
    for k in range(400):
        item = "".join(rnd.choice("ab" if k % 2 else "abcd") for _ in range(rnd.randint(1, 24)))
        text = "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 20))) + edited(rnd, item, 0.2) * (k % 3 > 0)
        low = rnd.randint(-len(item), len(text))
        lanes.append((item.encode(), text.encode(), rnd.randint(0, 6), low, low + rnd.randint(0, 20)))
    m, n, limit, low, high = (np.array(v) for v in zip(*((len(i), len(t), *r) for i, t, *r in lanes), strict=True))
    lo = np.cumsum(n) - n
    got = dc.alignments(np.frombuffer(b"".join(v[0] for v in lanes), np.uint8), np.cumsum(m) - m, m,
                        np.frombuffer(b"".join(v[1] for v in lanes), np.uint8), lo, lo + n, low, high, limit)
    want = [plain_band(*v) for v in lanes]
    assert [tuple(v) for v in got.T.tolist()] == want and 100 < sum(v[0] >= 0 for v in want) < 390


def test_regions_do_not_cost_a_call_per_row(spark):
    """Texts that share q-grams with a piece, but no match, are refused together:
    the calls a batch takes hardly grow with their number."""
    rnd = random.Random(11)
    body = kept(words(rnd, 60))[:100]
    cfg = dc.Settings()
    index = dc.Index([{"item_id": 1, "piece": 0, "item_start": 0, "item_total": 100, "body": body}], cfg)

    def calls(n):
        texts = [(body[:60] + words(rnd, 20).encode()).decode() for _ in range(n)]
        batch = dc.pa.RecordBatch.from_arrays([dc.pa.array(range(n)), dc.pa.array(texts)], ["doc_id", "text"])
        x, offs, *_ = dc.normalised(batch.column("text"))
        assert len(index.regions(x, offs)[0]) >= n
        count = [0]

        def tick(frame, event, arg):
            count[0] += event in ("call", "c_call")
        search = dc._search(index)
        sys.setprofile(tick)
        try:
            rows = [r for b in search([batch]) for r in b.to_pylist()]
        finally:
            sys.setprofile(None)
        assert not rows
        return count[0]

    assert calls(300) - calls(100) < 200 * 30
