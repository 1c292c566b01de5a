"""Cases in which an operator once did less than the whole job."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathsift.llm import distribution_rules, labelled

COLUMNS = "doc_id bigint, text string, lang string"


def prose(rnd, vowels, n):
    """A language of 150 words, the common ones far more frequent."""
    words = ["".join(rnd.choice("bdfgklmnprst") + rnd.choice(vowels) for _ in range(1 + k % 4)) + vowels[k % 2] * (k // 90)
             for k in range(150)]
    return lambda: " ".join(rnd.choices(words, [1 / (k + 2) for k in range(150)], k=n))


def test_texts_without_own_reference_are_held_to_the_nearest(spark):
    rnd = random.Random(5)
    first, second, third = prose(rnd, "ae", 160), prose(rnd, "iu", 160), prose(rnd, "oy", 160)
    rows = [(k, first(), "en") for k in range(1500)] + [(2000 + k, second(), "de") for k in range(90)]
    lone = {3000: None, 3001: "", 3002: "de-AT", 3003: None}
    rows += [(k, second(), lang) for k, lang in lone.items()] + [(3004, first(), None)]
    junk = " ".join("".join(rnd.choice("bcdfghjkvwxzq") for _ in range(5)) for _ in range(160))
    rows += [(4000, junk, None), (4001, junk, "en")]
    # a language of 40 texts is a large one in absolute terms, whatever its share
    rows += [(5000 + k, third(), "fi") for k in range(40)]
    rules = distribution_rules.Rules(min_share=0.04, reference_words=5000)
    got = {r["doc_id"]: r for r in distribution_rules.judge(spark.createDataFrame(rows, COLUMNS), rules).collect()}
    assert len(got) == len(rows)
    assert {k for k, r in got.items() if not r["kept"]} == {4000, 4001}
    own = max(r["word_distance"] for k, r in got.items() if 2000 <= k < 3000)
    assert all(got[k]["word_distance"] < own + 0.03 for k in lone)


def junk(rnd, n):
    return " ".join("".join(rnd.choice("bcdfghjkvwxzq") for _ in range(5)) for _ in range(n))


def test_junk_is_no_reference_of_its_own(spark):
    """Junk under its own label, under null, under a rare label and in copies; a clean rare language stays."""
    rnd = random.Random(8)
    first, rare = prose(rnd, "ae", 160), prose(rnd, "oy", 160)
    rows = [(k, first(), "en") for k in range(800)] + [(2000 + k, rare(), "fi") for k in range(12)]
    rows += [(3000 + k, junk(rnd, 160), "xx") for k in range(40)] + [(3100 + k, junk(rnd, 160), None) for k in range(5)]
    rows += [(3200, junk(rnd, 160), "yy"), (3201, junk(rnd, 160), "fi")]
    copy = junk(rnd, 160)
    rows += [(3300 + k, copy, "zz") for k in range(30)]
    got = {r["doc_id"]: r["kept"] for r in distribution_rules.judge(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert {k for k, kept in got.items() if not kept} == {k for k in got if k >= 3000}


def test_distances_and_verdicts_against_brute_force(spark):
    """Both distances with the text left out of its reference, and `kept`, by plain dictionaries."""
    rnd = random.Random(4)
    langs = {"en": prose(rnd, "ae", 120), "de": prose(rnd, "iu", 120)}
    rows = [(k, langs[lang](), lang) for k, lang in enumerate(rnd.choices(["en", "de"], [4, 1], k=150))]
    rows += [(900, junk(rnd, 150), "en"), (901, "A1! " * 40 + langs["de"](), "de"), (902, "", "en"), (903, None, "de"), (904, "short", "de")]
    rules = distribution_rules.Rules()
    names = ["space", "lower", "upper", "digit", "mark", "other", "control", "wide"]

    def kind(c):
        return ("space" if c in " \t\n\x0b\x0c\r" else "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if c.isdigit()
                else "mark" if c in ".,;:?'\"-()" else "other")

    def jsd(p, q):
        import math
        out = 0.0
        for k in {*p, *q}:
            a, b = p.get(k, 0.0), q.get(k, 0.0)
            out += (a * math.log2(2 * a / (a + b)) if a else 0) / 2 + (b * math.log2(2 * b / (a + b)) if b else 0) / 2
        return math.sqrt(max(out, 0.0))

    def shares(counts):
        total = sum(counts.values())
        return {k: v / total for k, v in counts.items() if v} if total else {}

    from collections import Counter
    words = {d: Counter((t or "").lower().split()) for d, t, _ in rows}
    chars = {d: Counter(map(kind, t or "")) for d, t, _ in rows}
    assert all(k in names for c in chars.values() for k in c)
    refs = {lang: (sum((words[d] for d, _, x in rows if x == lang), Counter()), sum((chars[d] for d, _, x in rows if x == lang), Counter()))
            for lang in langs}
    tops = {lang: [w for w, _ in sorted(refs[lang][0].items(), key=lambda x: -x[1])] for lang in langs}
    got = {r["doc_id"]: r for r in distribution_rules.judge(spark.createDataFrame(rows, COLUMNS), rules).collect()}
    import math
    for d, _, lang in rows:
        n = sum(words[d].values())
        if n < 100:
            continue
        edge = refs[lang][0][tops[lang][rules.common_words - 1]] if len(tops[lang]) >= rules.common_words else 0
        sure = {w for w in tops[lang] if refs[lang][0][w] > edge}
        if len(sure) < len(tops[lang]):
            continue                                    # ties at the edge of the common words: any of them may be in
        left = refs[lang][0] - words[d]
        q = shares(left)
        p = shares(words[d])
        fold = lambda x: {**{w: v for w, v in x.items() if w in sure}, None: sum(v for w, v in x.items() if w not in sure)}
        want_word = jsd(fold(p), fold(q))
        want_char = jsd(shares(chars[d]), shares(refs[lang][1] - chars[d]))
        assert abs(got[d]["word_distance"] - want_word) < 1e-6 and abs(got[d]["char_distance"] - want_char) < 1e-6
        c = sum(chars[d].values())
        ok = want_char ** 2 <= rules.char_limit ** 2 + rules.slack * 8 / (8 * math.log(2) * c) and \
            want_word ** 2 <= rules.word_limit ** 2 + rules.slack * rules.common_words / (8 * math.log(2) * n)
        assert got[d]["kept"] == (ok and not got[d]["base_failed"])
    assert not got[900]["kept"]


def training_ids(spark, n):
    """Ids that are not held out, in the order in which the sample takes them."""
    rows = spark.range(n).selectExpr("id AS doc_id").filter(~labelled.held_out()).orderBy(F.xxhash64("doc_id")).collect()
    return [r[0] for r in rows]


@pytest.mark.parametrize("case", ["huge", "hot"])
def test_label_sample_keeps_every_class(spark, case):
    """A huge text, or an id of many rows, that comes first of its class."""
    ids = training_ids(spark, 60)
    rows = [(k, f"text {k}", "en") for k in ids]
    if case == "huge":
        rows[0] = ids[0], "x " * 6000, "en"                # above the class's half of the budget
        rows[1] = ids[1], "y " * 2400, "en"                # fits, and would leave nothing for the others
    else:
        rows += [(ids[0], f"text {ids[0]}", "en")] * 50 + [(ids[0], f"other text {j}", "en") for j in range(50)]
    labels = spark.createDataFrame([(k, int(j % 9 == 0 or j == 1)) for j, k in enumerate(ids)], "doc_id bigint, toxic int")
    sample, _ = labelled.sample_texts(spark.createDataFrame(rows, COLUMNS), labels, "toxic", 20, 10_000)
    got = sample.to_pydict()
    toxic = [t for t, y in zip(got["text"], got["label"], strict=True) if y == 1]
    want = [f"text {k}" for j, k in enumerate(ids) if j % 9 == 0 or j == 1]
    assert toxic == (want if case == "hot" else ["y " * 2400, *want[2:]])
    assert got["label"].count(0) == 20


def test_label_sample_says_when_a_class_is_missing(spark):
    ids = training_ids(spark, 30)
    docs = spark.createDataFrame([(k, "z" * (500 if j == 0 else 5), "en") for j, k in enumerate(ids)], COLUMNS)
    labels = spark.createDataFrame([(k, int(j == 0)) for j, k in enumerate(ids)], "doc_id bigint, toxic int")
    with pytest.raises(ValueError, match="toxic = 1"):
        labelled.sample_texts(docs, labels, "toxic", 20, 900)
    with pytest.warns(RuntimeWarning, match="toxic = 1"):
        sample, shift = labelled.sample_texts(docs, labels.filter("toxic = 0"), "toxic", 20, 900)
    assert sample.num_rows == 0 and shift == 0.0


def test_chains_cover_whole_lines():
    """Marginals of a line of 1,300 tokens, by sums over both states one token at a time."""
    import numpy as np

    from pathsift.llm import common, toxicity_crf
    rnd = np.random.default_rng(3)
    text = pa.array(["a b\n" + " ".join(f"w{k % 37}" for k in range(1300)) + "\nz", "one"])
    data, offs = common.buffers(text)
    s, e, doc = toxicity_crf.tokens(data, offs)
    first = toxicity_crf.chains(data, offs, s, doc)
    assert list(first) == [0, 2, 1302, 1303]
    emit, trans = rnd.normal(size=len(s)), np.array([[0.3, -1.0], [-0.4, 0.9]])
    p = toxicity_crf.Chains(first, len(s)).marginals(emit, trans)[0]
    t, up = np.exp(trans), np.exp(emit)
    f = np.array([1.0, up[2]]) / (1 + up[2])
    fore = [f]
    for k in range(3, 1302):
        f = (f @ t) * np.array([1.0, up[k]])
        f /= f.sum()
        fore.append(f)
    b = np.ones(2)
    for k in range(1301, 1, -1):
        both = fore[k - 2] * b
        assert abs(p[k] - both[1] / both.sum()) < 1e-9
        b = t @ (np.array([1.0, up[k]]) * b)
        b /= b.sum()
