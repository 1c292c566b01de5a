"""Operator 13 against a search over all edit sequences by cost and spelling."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from pathsift.llm import conversation_repair as cr

COLUMNS = "conv_id bigint, turn bigint, role string, text string, key string, piece string"
EMPTY = hashlib.sha256().hexdigest()
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        yield from [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def marked(rows):
    seen, out = set(), []
    for t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())):
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((t, role, text, fault))
    return out


def brute(rows):
    """Cheapest, then least, edits by uniform-cost search over (row, initials so
    far as a grammar state found by matching the spelled roles themselves)."""
    rows = marked(damage(rows))
    turns = {t for t, *_ in rows if t is not None}
    first = lambda r: r[:1]
    facts = [max(turns) - min(turns) + 1 - len(turns) if turns else 0,
             *(sum(f == name for *_, f in rows) for name in ("blank", "duplicate", "truncated")),
             sum(first(a[1]) + first(b[1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))]
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, out = heapq.heappop(heap)
        if at == len(rows) and GRAMMAR.fullmatch(initials):
            return (*facts, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
        # what can follow depends on the last initial only
        if (at, initials[-1:]) in done and len(out) > 0 or not any(GRAMMAR.fullmatch(initials + x) for x in ("", "a", "ua")):
            continue
        done.add((at, initials[-1:]))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", at, initials + role[0], (*out, role + ":")))
        if at < len(rows):
            _, role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, initials, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, initials + role[0], (*out, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, initials + to[0], (*out, f"{to}:{text}")))
    return (*facts, 0, "", EMPTY)


def conversations(n, seed, longest):
    rnd = random.Random(seed)
    out = []
    for c in range(n):
        turns = rnd.choice([range(longest), range(rnd.randint(1, longest)), [None, 1, 1, 2, 9]])
        for t in turns:
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "usher"])
            out.append((c, t, role, rnd.choice([None, "", " \n", "yes.", "no", "what?", f"text {rnd.randrange(9)}.", "so\x0b", "end. "])))
    return out + [(None, 1, "user", "q?"), (None, None, "assistant", "a."), (None, 3, None, None)]


def held_to(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], COLUMNS).repartition(4)
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.repair(df, **kw).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert got == {c: brute(rs) for c, rs in by.items()}
    return got


@pytest.mark.parametrize("piece_rows", [1024, 2, 3])
def test_against_search(spark, piece_rows):
    held_to(spark, conversations(150, piece_rows, 9), piece_rows=piece_rows)


def test_long_and_common_conversations(spark):
    rows = [(0, t, ("user", "assistant")[t % 2], f"t {t}.") for t in range(3000)]
    rows += [(c, t, r, x) for c in range(1, 300) for t, (r, x) in enumerate([("user", "same."), ("assistant", "same too.")])]
    rows += [(500, 1, "user", "very long " * 50_000 + "."), (500, 2, "assistant", "ok.")]
    got = held_to(spark, rows)
    assert len({g[6] for g in got.values()}) > 1


def test_no_row_left_and_empty_table(spark):
    gone = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = held_to(spark, [(7, gone, "user", "hello.")])
    assert got == {7: (0, 0, 0, 0, 0, 0, "", EMPTY)}
    assert cr.repair(spark.createDataFrame([], COLUMNS)).count() == 0


def test_nodes_are_shared():
    """Every suffix is one node, with the least of all audits."""
    made = []
    real = cr.node
    cr.node = lambda *a: made.append(a[0]) or real(*a)
    try:
        import pyarrow as pa
        sigs = sorted({"uauA", "auA", "xuA", "suaA", "uaua"}, key=lambda s: s[::-1])
        schema = pa.schema([("sig", pa.string()), ("last", pa.bool_()), ("costs", pa.list_(pa.int32())),
                            ("audits", pa.list_(pa.string())), ("ranks", pa.list_(pa.int32()))])
        out = list(cr._automaton(schema)([pa.RecordBatch.from_pydict({"sig": sigs, "last": [True] * 5})]))[0].to_pylist()
    finally:
        cr.node = real
    assert len(made) == len({s[k:] for s in sigs for k in range(len(s))})
    assert {r["sig"]: (r["costs"][0], r["audits"][0]) for r in out}["auA"] == (3, "IKKK")
