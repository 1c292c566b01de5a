"""Every dealt operator on small tables: edge cases and brute-force versions."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from pathsift.llm import (decontaminate, distribution_rules, jaccard_join, length_buckets, maxent_lm, quality_fm,
                          suffix_dedup, token_counts, token_packing, toxicity_crf)
from pathsift.llm.common import scratch_path
from pathsift.llm.tokens import default_tokenizer, encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, n bigint, cls string"
LABELS = "doc_id bigint, quality int, toxic int"


def table(spark, texts):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "x") for i, t in texts], SCHEMA)


def corpus(seed=3, n=120):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeiounrst") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 120))) for _ in range(n)]
    out = []
    for k in range(n):
        t = base[k]
        if k % 5 == 1:
            t = base[k - 1]                                     # an exact copy
        if k % 5 == 2:
            w = base[k - 2].split()
            w[rnd.randrange(len(w))] = "changed"                # a near copy
            t = " ".join(w).upper() if k % 2 else " ".join(w)
        out.append((k, t))
    return out + [(500, None), (501, ""), (502, "two words"), (503, "two words"), (504, " \n\t"), (None, base[3]),
                  (505, base[0] + "\n" + base[0]), (506, "aa " * 900), (506, "aa " * 900), (507, "é" * 300)]


def sets(t):
    w = WORD.findall((t or "").translate(FOLD))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else zip(*(w[k:] for k in range(5)), strict=False))


def test_jaccard_components_match_brute_force(spark):
    rows = corpus()
    s = [(i, sets(t)) for i, t in rows]
    parent = list(range(len(s)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            c = len(s[a][1] & s[b][1])
            if c and 100 * c >= 75 * (len(s[a][1]) + len(s[b][1]) - c):
                parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(s):
        if i is not None:
            least[find(k)].append(i)
    want = sorted((str(i), len(g), min(least[find(k)], default=None)) for k, (i, g) in enumerate(s))
    got = sorted((str(r[0]), r[1], r[2]) for r in jaccard_join.components(table(spark, rows)).select(
        "doc_id", "n_shingles", "component_id").collect())
    assert got == want


def test_near_copy_family_is_one_component(spark):
    """A chain: neighbours are linked, the ends are not."""
    w = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(w)))
        w[k * 9] = f"x{k}"
    got = {r[0]: r[2] for r in jaccard_join.components(table(spark, rows)).collect()}
    assert set(got.values()) == {0}


def removed(rows, length=100):
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for i, t in docs:
        b = t.encode()
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            x = b[p:p + length]
            if x in seen:
                gone[p] += 1
                gone[p + length] -= 1
            seen.add(x)
        gone = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_matches_brute_force(spark):
    rows = corpus()
    want = removed(rows)
    got = suffix_dedup.removals(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want[r[0]], r[0]


def test_cut_documents_keeps_clean_texts(spark):
    rows = [(1, "a clean text"), (2, "".join(map(chr, range(97, 120))) * 10), (3, "".join(map(chr, range(97, 120))) * 10),
            (4, None)]
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.cut_documents(table(spark, rows)).collect()}
    assert got[1] == "a clean text" and got[4] is None and 3 not in got


def test_loser_tree_merge():
    rnd = random.Random(5)
    runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(0, 30)))
            for _ in range(7)]

    def lcp(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    shared = [[lcp(r[i - 1], r[i]) if i else 0 for i in range(len(r))] for r in runs]
    order, prefix = suffix_dedup.merge_runs(runs, shared)
    merged = [runs[r][i] for r, i in order]
    assert merged == sorted(x for r in runs for x in r)
    assert all(prefix[k] == lcp(merged[k - 1], merged[k]) for k in range(1, len(merged)))


def test_token_counts_and_cache(spark):
    rows = corpus(n=30) + [(900, "a<|endoftext|>b"), (901, "日本語 text")]
    path, tok = scratch_path(spark, "cache"), default_tokenizer()
    enc = encoder(tok)
    got = token_counts.token_counts(table(spark, rows), path, tok).collect()
    want = collections.Counter((i, len((t or "").encode()), len(enc.whole(t or ""))) for i, t in rows)
    assert collections.Counter((r[0], r[1], r[2]) for r in got) == want
    before = spark.read.parquet(path).count()
    token_counts.token_counts(table(spark, rows), path, tok).count()
    assert spark.read.parquet(path).count() == before == len({t or "" for _, t in rows})


def test_tokenizer_pieces_equal_library():
    enc, rnd = encoder(default_tokenizer()), random.Random(1)
    parts = ["a", "É", " ", "  ", "\n", "'s", "'", "1", "²", ".", "!!", "\xa0", "\x85", "<|endoftext|>", "<|end", "ß", "\t", "—"]
    for _ in range(3000):
        x = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert enc.ids(x) == enc.whole(x) and enc.count(x) == len(enc.whole(x))


def test_packing_round_trip(spark):
    rows = corpus(n=40)
    enc = encoder(default_tokenizer())
    out = token_packing.packed_rows(table(spark, rows), default_tokenizer(), seq_len=64, shard_bytes=4000).collect()
    ids = collections.defaultdict(list)
    for r in out:
        row = np.frombuffer(r["input_ids"], "<u2")
        assert len(row) == 64 and r["cu_seqlens"][-1] == r["n_tokens"] <= 64
        assert r["position_resets"] == r["cu_seqlens"][:-1]
        assert (token_packing.position_ids(r["cu_seqlens"]) < 64).all()
        for d, p, a, b in zip(r["doc_ids"], r["pieces"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True):
            ids[d].append((p, row[a:b].tolist()))
    for i, t in rows:
        if i != 506:
            assert sum((x for _, x in sorted(ids[i])), []) == enc.ids(t or ""), i


def test_best_fit_decreasing():
    rnd = random.Random(2)
    sizes = [rnd.randint(0, 50) for _ in range(300)]
    rows = token_packing.best_fit_decreasing(sizes, 50)
    assert sorted(i for r in rows for i in r) == list(range(300))
    assert all(sum(sizes[i] for i in r) <= 50 for r in rows)
    left, want = [], 0          # the plain quadratic version opens as many rows
    for s in sorted(sizes, reverse=True):
        fit = [k for k, c in enumerate(left) if c >= s]
        if fit:
            k = min(fit, key=lambda k: left[k])
            left[k] -= s
        else:
            left.append(50 - s)
            want += 1
    assert len(rows) == want


def test_optimal_widths_match_brute_force():
    import itertools
    rnd = random.Random(4)
    for _ in range(20):
        w = np.array(sorted(rnd.sample(range(1, 60), 9)))
        n = np.array([rnd.randint(1, 20) for _ in w])
        cost = lambda b: sum(c * min(x for x in b if x >= a) for a, c in zip(w, n, strict=True))  # noqa: E731, B023
        got = length_buckets.optimal_widths(w, n, 3)
        want = min(cost((*c, w[-1])) for c in itertools.combinations(w[:-1], 2))
        assert cost(got) == want


def test_length_batches(spark):
    rows = corpus()
    lengths = length_buckets.token_lengths(table(spark, rows), default_tokenizer())
    out = length_buckets.length_batches(lengths, n_buckets=4, token_budget=256, shard_rows=8).collect()
    assert len(out) == len(rows)
    used = collections.Counter()
    for r in out:
        assert r["n_tokens"] <= r["width"] and r["padding"] == r["width"] - r["n_tokens"]
        used[r["bucket"], r["batch"]] += r["width"]
    assert all(v <= 256 or v == r_width for (v, r_width) in ((v, max(r["width"] for r in out if (r["bucket"], r["batch"]) == k))
                                                              for k, v in used.items()))


@pytest.mark.parametrize("n_buckets", [1, 3])
def test_length_batches_against_brute_force(spark, n_buckets):
    """Least padding over all bucket bounds; full batches but a bucket's last; wide rows in batches of one; one hot id."""
    rnd = random.Random(n_buckets)
    rows = [(rnd.choice([None, 7, k]), rnd.choice([0, 1, 7, 8, 9, 20, 33, 64, 65, 100])) for k in range(300)]
    rows += [(7, 8)] * 150 + [(k, 65 * k + 200) for k in range(5)]
    budget = 128
    lengths = spark.createDataFrame(rows, "doc_id bigint, n_tokens int").repartition(5)
    out = length_buckets.length_batches(lengths, n_buckets=n_buckets, token_budget=budget, shard_rows=16).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in out) == sorted((str(d), n) for d, n in rows)
    up = lambda n: max(-(-n // 8), 1) * 8
    fit = [n for _, n in rows if up(n) <= budget]
    widths = sorted({up(n) for n in fit})
    best = min(sum(min(b for b in (*cut, widths[-1]) if b >= up(n)) - n for n in fit)
               for cut in itertools.combinations(widths[:-1], min(n_buckets, len(widths)) - 1))
    narrow = [r for r in out if up(r["n_tokens"]) <= budget]
    assert sum(r["padding"] for r in narrow) == best
    batches = collections.defaultdict(list)
    for r in out:
        batches[r["bucket"], r["batch"]].append(r)
    for (bucket, batch), rs in batches.items():
        assert len({r["width"] for r in rs}) == 1 and sorted(r["slot"] for r in rs) == list(range(len(rs)))
        full = max(budget // rs[0]["width"], 1)
        last = batch == max(b for k, b in batches if k == bucket)
        assert len(rs) == full or last and len(rs) < full
    wide = [r for r in out if up(r["n_tokens"]) > budget]
    assert len({(r["bucket"], r["batch"]) for r in wide}) == 5 and all(r["width"] == up(r["n_tokens"]) for r in wide)


def test_distribution_base_facts(spark):
    rows = corpus() + [(700, "x y z x y z\nline one\n\nline one\n | # a"), (701, "same\nsame\nsame \n")]
    for r in distribution_rules.judge(table(spark, rows)).collect():
        t = dict(rows)[r["doc_id"]] or ""
        w = WORD.findall(t)
        tri = list(zip(w, w[1:], w[2:], strict=False))
        c = collections.Counter(tri)
        hit = {k + d for k, g in enumerate(tri) if c[g] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_js_distance_bounds():
    p, q = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert distribution_rules.js_distance(p, q) == pytest.approx(1.0)
    assert distribution_rules.js_distance(p, p) == 0


def test_language_model_base_and_sum(spark):
    rows = corpus()
    got = maxent_lm.lm_scores(table(spark, rows)).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    toks = [(i, [*WORD.findall((t or "").translate(FOLD)), None]) for i, t in rows]
    c = collections.Counter(w for i, ws in toks if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n,
                   round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in toks)
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_decontamination_finds_edited_passages(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    item = " ".join(word() for _ in range(30))
    near = list(item)
    for k in (20, 60, 100):
        near[k] = "z"
    noise = lambda: " ".join(word() for _ in range(200))
    docs = table(spark, [(1, noise() + " " + item.upper() + "! " + noise()), (2, noise() + "".join(near)), (3, noise()),
                         (4, None), (5, ""), (None, item), (6, item[:60])])
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short"), (None, "")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) == {(1, 7), (2, 7), (None, 7)}
    assert got[1, 7] == 0 and 0 < got[2, 7] <= 3


def test_banded_alignment_matches_plain_dp():
    rnd = random.Random(11)
    for _ in range(60):
        a = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 8)))
        t = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12)))
        row = [0] * (len(t) + 1)
        for k, c in enumerate(a):
            new = [k + 1]
            for j, d in enumerate(t):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
            row = new
        found = decontaminate.banded_alignment(np.frombuffer(a, np.uint8), np.frombuffer(t, np.uint8), len(a))
        assert found[0] == min(row)


def labelled_corpus():
    rnd = random.Random(8)
    words = ["".join(rnd.choice("aeioulmnrst") for _ in range(6)) for _ in range(300)]
    docs, labels = [], []
    for k in range(600):
        text = " ".join(rnd.choice(words) for _ in range(60))
        bad, toxic = k % 4 == 0, k % 5 == 0
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            w = text.split()
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(["scumbag", "scumball", "morons"]))
            text = " ".join(w)
        docs.append((k, text))
        labels.append((k, int(not bad), int(toxic)))
    return docs + [(9000, None), (9001, ""), (None, "x")], labels + [(None, 1, 1), (7777, None, None)]


def test_classifiers_on_held_out_rows(spark):
    docs, labels = labelled_corpus()
    d, lab = table(spark, docs), spark.createDataFrame(labels, LABELS)
    fm = quality_fm.train(d, lab)
    truth = {k: (q, t) for k, q, t in labels if k is not None}
    rows = quality_fm.scores(d, fm).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert held and np.mean([r["predicted"] == truth[r["doc_id"]][0] for r in held]) > 0.95
    crf = toxicity_crf.train(d, lab)
    rows = toxicity_crf.scores(d, crf).collect()
    assert len(rows) == len(docs)
    by_id = dict(docs)
    good = [(r["score"] >= 0.7) == truth[r["doc_id"]][1] for r in rows if r["doc_id"] in truth]
    assert np.mean(good) > 0.95
    for r in rows:
        for s in r["spans"]:
            assert by_id[r["doc_id"]][s["start"]:s["stop"]].strip()


def test_pairwise_identity():
    cfg = quality_fm.Settings(word_buckets=32, factors=3)
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(cfg, 0.1, rng.normal(size=40).astype("f4"), rng.normal(size=(40, 3)).astype("f4"))
    idx, val = np.array([1, 5, 9]), np.array([0.5, 1.0, 2.0], "f4")
    z, _ = m.raw(np.array([0, 3]), idx, val)
    want = 0.1 + (m.w[idx] * val).sum() + sum(m.v[a] @ m.v[b] * x * y for k, (a, x) in enumerate(zip(idx, val, strict=True))
                                             for b, y in list(zip(idx, val, strict=True))[k + 1:])
    assert z[0] == pytest.approx(want, rel=1e-4)


def test_forward_backward_matches_enumeration():
    import itertools
    emit, trans = np.array([0.3, -1.0, 0.7, 0.2]), np.array([[0.1, -0.5], [0.4, 0.9]])
    p, _, _ = toxicity_crf.Chains(np.array([0]), 4).marginals(emit, trans)
    total, toxic = 0.0, np.zeros(4)
    for y in itertools.product((0, 1), repeat=4):
        w = math.exp(sum(e * s for e, s in zip(emit, y, strict=True)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        toxic += w * np.array(y)
    assert p == pytest.approx(toxic / total)


@pytest.mark.parametrize("op", ["jaccard", "suffix", "tokens", "packing", "buckets", "rules", "lm", "bench", "fm", "crf"])
def test_empty_tables(spark, op):
    d = table(spark, [])
    lab = spark.createDataFrame([], LABELS)
    tok = default_tokenizer()
    out = {
        "jaccard": lambda: jaccard_join.components(d), "suffix": lambda: suffix_dedup.removals(d),
        "tokens": lambda: token_counts.token_counts(d, scratch_path(spark, "c"), tok),
        "packing": lambda: token_packing.packed_rows(d, tok),
        "buckets": lambda: length_buckets.length_batches(length_buckets.token_lengths(d, tok)),
        "rules": lambda: distribution_rules.judge(d), "lm": lambda: maxent_lm.lm_scores(d),
        "bench": lambda: decontaminate.matches(d, spark.createDataFrame([], "item_id bigint, text string")),
        "fm": lambda: quality_fm.scores(d, quality_fm.train(d, lab)),
        "crf": lambda: toxicity_crf.scores(d, toxicity_crf.train(d, lab)),
    }[op]()
    assert out.collect() == []
