import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import neardup as N
from tarn.storage import Scratch


def dice(a, b):
    x, y = set(N.grams(a, 3).tolist()), set(N.grams(b, 3).tolist())
    return 2 * len(x & y) / (len(x) + len(y))


def test_the_code_is_perfect():
    _, home, near = N._code()
    assert len(set(home.tolist())) == 2048 and max(int(e).bit_count() for e in home) == 3
    assert (near >= 0).sum() == 1 + 23 + 253 + 1771 + 8855
    r = np.random.default_rng(0)
    w = r.integers(0, 1 << 23, 500)
    home, to = N.anchors(w)
    assert (to == home[:, None]).any(axis=1).all()
    assert np.bitwise_count(home ^ w).max() <= N.RADIUS
    # every block within one bit meets at the home anchor
    v = w ^ (1 << r.integers(0, 23, 500))
    assert (N.anchors(v)[1] == home[:, None]).any(axis=1).all()
    # no block within radius plus threshold of an anchor is left out
    words = np.unique(N.anchors(np.arange(0, 1 << 23, 997))[0])
    assert all(set(words[np.bitwise_count(words ^ x) <= N.RADIUS + N.THRESHOLD].tolist()) <= set(t[t >= 0].tolist()) for x, t in zip(w[:20], to[:20], strict=True))


WORDS = "退款已原路退回礼品卡预计完成派送维修点设在前置仓检测费由责任方承担运单号显示同样处理过一次安装预约改到说明书可在页面下载"


def text(r, n=160):
    return "".join(r.choice(WORDS) + (str(r.randrange(1000)) if r.random() < 0.2 else "") for _ in range(n))


def edited(r, t):
    x = list(t)
    for _ in range(r.randrange(1, 8)):
        i = r.randrange(len(x))
        x[i : i + r.randrange(2)] = [r.choice(WORDS)]
    k = r.randrange(len(x))
    return "".join(x[k:] + x[:k]) if r.random() < 0.3 else "".join(x)


def run(spark, rows, **k):
    df = spark.createDataFrame(rows, "id string, q string, a string")
    return N.near_duplicates(df, "id", ["q", "a"], Scratch(spark, "t"), **k)


def test_classes_equal_brute_force(spark):
    r = random.Random(3)
    texts = []
    for _ in range(60):
        t = text(r)
        texts += [t] + [edited(r, t) for _ in range(r.randrange(4))]
    rows = [(f"i{i:04d}", t[:40], t[40:]) for i, t in enumerate(texts)]
    classes, links = run(spark, rows)
    p = list(range(len(texts)))

    def f(x):
        while p[x] != x:
            x = p[x]
        return x

    plain = [spark.createDataFrame([(a + "\n" + b,)], "t string").select(N.plain(F.col("t"))).first()[0] if False else (a + b) for _, a, b in rows]
    for i in range(len(plain)):
        for j in range(i):
            if dice(plain[i], plain[j]) >= N.SIMILARITY:
                p[f(i)] = f(j)
    want = {}
    for i in range(len(plain)):
        want.setdefault(f(i), set()).add(rows[i][0])
    want = {frozenset(v) for v in want.values() if len(v) > 1}
    got = {}
    for x in classes.collect():
        got.setdefault(x["class"], set()).add(x.id)
    assert {frozenset(v) for v in got.values()} == want
    assert all(k == min(v) for k, v in got.items())
    assert links.where("id_a = id_b").count() == 0


def test_copies_nulls_and_empty_texts(spark):
    rows = [("a", "同一 文本，内容很长一些", None), ("b", "同一文本内容很长一些", ""), ("c", None, None), ("d", "", " 。"), (None, "同一文本内容很长一些", None), ("e", "另外的文字毫不相干", "x"), ("a", "同一 文本，内容很长一些", None)]
    classes, _ = run(spark, rows)
    assert {(r.id, r["class"], r.copies, r.links) for r in classes.collect()} == {("a", "a", 2, 0), ("b", "a", 2, 0)}
    assert {tuple(r) for r in N.class_pairs(classes).collect()} == {("a", "b")}
    assert run(spark, [])[0].count() == 0


@pytest.mark.parametrize("rows_at_once", [4, 20_000])
def test_hot_class_is_whole_without_all_its_pairs(spark, rows_at_once):
    r = random.Random(8)
    base = text(r, 200)
    rows = [(f"h{i:04d}", base, f"单号 {i:05d}") for i in range(150)] + [(f"x{i:04d}", text(r), "") for i in range(150)]
    t = text(r)
    rows += [("y1", t, "甲"), ("y2", t, "乙")]
    classes, _ = run(spark, rows, group_rows=rows_at_once)
    got = {}
    for x in classes.collect():
        got.setdefault(x["class"], set()).add(x.id)
    # links are those of the representative, however the class was found
    assert sorted(x.links for x in classes.collect() if x["class"] == "h0000") == [1] * 149 + [149]
    assert got == {"h0000": {f"h{i:04d}" for i in range(150)}, "y1": {"y1", "y2"}}


def test_very_long_and_very_short_texts(spark):
    r = random.Random(2)
    t = text(r, 20000)
    classes, _ = run(spark, [("a", t, ""), ("b", t[:300] + "换" + t[301:], ""), ("c", "x", ""), ("d", "y", ""), ("e", "X", "!")])
    assert {(x.id, x["class"]) for x in classes.collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("e", "c")}


def test_pairs_near_the_limit_are_all_found(spark):
    r = random.Random(11)
    rows, want = [], set()
    while len(want) < 120:
        t = text(r, 120)
        x = list(t)
        for i in r.sample(range(len(x)), r.randrange(12, 20)):
            x[i] = r.choice(WORDS)
        if 0.70 <= dice(t, "".join(x)) < 0.80:
            k = len(want)
            rows += [(f"a{k:03d}", t, ""), (f"b{k:03d}", "".join(x), "")]
            want.add((f"a{k:03d}", f"b{k:03d}"))
    classes, _ = run(spark, rows, exact=True)
    assert {tuple(x) for x in N.class_pairs(classes).collect()} == want


LETTERS = [chr(0x4E00 + i) for i in range(1500)]
OFTEN = [1 / (i + 5) for i in range(1500)]


def changed(r, t, kind, f):
    x, n = list(t), len(t)
    if kind == "replaced":
        for i in r.sample(range(n), max(1, int(f * n))):
            x[i] = r.choices(LETTERS, OFTEN)[0]
    elif kind == "inserted":
        for _ in range(max(1, int(f * n))):
            x.insert(r.randrange(len(x)), r.choices(LETTERS, OFTEN)[0])
    elif kind == "moved":
        for _ in range(max(1, int(f * n / 3))):
            i, k = r.randrange(n), r.randrange(1, n // 4)
            part = x[i : i + k]
            del x[i : i + k]
            j = r.randrange(len(x) + 1)
            x[j:j] = part
    else:  # one run of the text rewritten
        k = max(1, int(2.5 * f * n))
        i = r.randrange(max(1, n - k))
        x[i : i + k] = r.choices(LETTERS, OFTEN, k=k)
    return "".join(x)


def test_anchors_alone_find_pairs_of_every_similarity(spark):
    r = random.Random(5)
    bands = {b: [] for b in (0.70, 0.75, 0.80, 0.85, 0.90)}
    while min(map(len, bands.values())) < 200:
        t = "".join(r.choices(LETTERS, OFTEN, k=r.choice([30, 60, 120, 300, 600])))
        u = changed(r, t, r.choice(["replaced", "inserted", "moved", "rewritten"]), r.uniform(0.02, 0.2))
        d = dice(t, u)
        b = next((b for b in sorted(bands, reverse=True) if b <= d), None)
        if b and len(bands[b]) < 200 and t != u:
            bands[b].append((t, u))
    rows = [(f"{side}{b:.2f}-{k:03d}", t, "") for b, pairs in bands.items() for k, both in enumerate(pairs) for side, t in zip("ab", both, strict=True)]
    classes, _ = run(spark, rows)
    found = {tuple(x) for x in N.class_pairs(classes).collect()}
    assert all(a[1:] == b[1:] for a, b in found)
    for b, least in zip(bands, (0.95, 0.97, 0.99, 0.99, 1.0), strict=True):
        assert sum((f"a{b:.2f}-{k:03d}", f"b{b:.2f}-{k:03d}") in found for k in range(200)) >= 200 * least, b
