"""Operator 11: codes, exchange and grouping against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathsift.llm import golomb_dedup as g

COLUMNS = "doc_id bigint, text string, norm string, file string"


def brute(rows):
    groups = {}
    for i, (k, text, *_) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append((k is None, k or 0, i))
    out = []
    for norm, members in groups.items():
        none, keep, at = min(members)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(rows[i][0], None if none else keep, len(members), sha) for _, _, i in members]
    return sorted(out, key=str), len(groups)


def held_to(spark, rows, cfg=None, path=None, **kw):
    df = spark.createDataFrame(rows, COLUMNS)
    if path:
        df.repartition(5).write.parquet(path)
        df = spark.read.parquet(path)
    got = g.exact_groups(df, cfg, **kw).collect()
    want, kept = brute(rows)
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == want
    stay = [r for r in got if r["kept"]]
    assert len(stay) == kept and all(r["doc_id"] == r["keep_id"] for r in stay)


def table(n=400, seed=3):
    rnd = random.Random(seed)
    texts = [None, "", " ", "\t\n", "a b", "a\x0b  b", "a b", "ünï çödé \n x", "w " * 60_000, "w " * 59_999 + "v "]
    texts += [f"text {k}" for k in range(60)]
    rows = [(rnd.choice([None, *range(150)]), rnd.choice(texts), "clash", str(k)) for k in range(n)]
    return rows + [(7, "hot", "", "")] * 200 + [(k, "hot", "", "") for k in range(500, 700)]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 5000])
@pytest.mark.parametrize("top", [8, 1 << 20, 1 << 47])
def test_codes_round_trip(n, top):
    v = np.unique(np.random.default_rng(n).integers(0, top, n))
    assert (g.decode(len(v), *g.encode(v)) == v).all()


def test_codes_are_small():
    v = np.unique(np.random.default_rng(1).integers(0, 1 << 42, 4096))
    assert len(g.encode(v)[1]) * 8 / len(v) < 42 - 12 + 2.2


def test_groups_against_brute_force(spark, tmp_path):
    held_to(spark, table(), path=str(tmp_path / "t"))
    held_to(spark, table(seed=9))                                 # not read from files


def test_many_blocks_and_runs(spark, tmp_path):
    held_to(spark, table(), g.Settings(run_rows=16, least_owner_bits=2, owner_hashes=64, block_rows=150),
            path=str(tmp_path / "t"))


def test_digest_of_two_texts(spark):
    """Groups rest on bytes: a digest that many texts share merges nothing."""
    held_to(spark, table(200), digest=lambda c: F.substring(F.md5(c.cast("binary")), 1, 1))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "t"))
    assert g.exact_groups(spark.read.parquet(str(tmp_path / "t"))).count() == 0
