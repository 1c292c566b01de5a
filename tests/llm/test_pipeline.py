"""The corpus pipeline against a brute-force version, with null and clashing ids."""

import collections
import hashlib
import random

import corpus_pipeline
from pathsift.llm import stages
from pathsift.llm.length_buckets import token_lengths
from pathsift.llm.tokens import default_tokenizer

from .test_operators import LABELS, sets, table


def rows_and_items():
    rnd = random.Random(21)
    words = ["".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(6)) for _ in range(3000)]

    def text(n=60):
        return " ".join(rnd.choice(words) for _ in range(n))

    def near(t):
        w = t.split()
        w[len(w) // 2] = "changed"
        return " ".join(w)

    a, b, c, d, e = (text() for _ in range(5))
    items, passage = [text(30), text(30)], text(25)
    rows = [(1, a), (2, near(a)), (2, text()), (3, b), (3, text()), (4, near(b)), (None, near(near(b))),
            (None, c), (None, c), (None, near(c)), (None, text()), (5, d), (5, d), (5, near(d)), (6, text()),
            (None, e + " " + items[0]), (7, text() + " " + items[1] + " " + text()), (7, text()),
            (None, text() + " " + passage + " " + text()), (8, text() + " " + passage + " " + text()),
            (None, None), (None, ""), (9, None), (9, ""), (9, " "), (10, "two words"), (None, "two words")]
    return rows + [(100 + k, text()) for k in range(20)], items


def key(row):
    i, t = row
    return i is None, i or 0, hashlib.md5(f"{'' if i is None else i}\n{t or ''}".encode()).digest()


def without_near_duplicates(rows):
    alone = [r for r in rows if not sets(r[1]) and r[0] is None]
    rows = list({key(r): r for r in rows if sets(r[1]) or r[0] is not None}.values())
    group = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            s, t = sets(rows[x][1]), sets(rows[y][1])
            if s and 100 * len(s & t) >= 75 * len(s | t):
                group = [group[y] if g == group[x] else g for g in group]
    least = {g: min((r for r, h in zip(rows, group, strict=True) if h == g), key=key) for g in set(group)}
    return alone + list(least.values())


def cut(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        gone = set()
        for p in range(len(t or "") - length + 1):
            if t[p:p + length] in seen:
                gone.update(range(p, p + length))
            seen.add(t[p:p + length])
        left = "".join(ch for p, ch in enumerate(t or "") if p not in gone)
        if left or not gone:
            out.append((i, left if gone else t))
    return out


def plain(df):
    """Rows as a multiset; the text of a copy that differs only by null and "" counts as one."""
    return collections.Counter((r["doc_id"], r["text"] or "") for r in df.collect())


def test_near_duplicate_stage_matches_brute_force(spark):
    rows, _ = rows_and_items()
    got = plain(stages.ngram_jaccard_join(spark, table(spark, rows), ""))
    assert got == collections.Counter((i, t or "") for i, t in without_near_duplicates(rows))


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, items = rows_and_items()
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")     # the classifier keeps all
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [(i, t) for i, t in cut(without_near_duplicates(rows)) if not any(x in (t or "") for x in items)]
    assert sum(i is None for i, _ in want) > 4 and sum(i == 7 for i, _ in want) == 1
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths = token_lengths(table(spark, want), default_tokenizer()).collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in out) == collections.Counter(
        (r["doc_id"], r["n_tokens"]) for r in lengths)
    assert all(r["padding"] == r["width"] - r["n_tokens"] >= 0 for r in out)
