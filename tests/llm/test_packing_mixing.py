import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import mixing as M
from tarn.llm import packing as P
from tarn.llm._text import sizes
from tarn.storage import Scratch


def brute_size(t):
    import unicodedata

    n, run = 0, False
    for ch in t or "":
        cat, cp = unicodedata.category(ch), ord(ch)
        if (cat in ("Cc", "Cf") and ch not in "\t\n\r") or cp in (0, 0xFFFD):
            continue
        han = 0x4E00 <= cp <= 0x9FFF or 0x3400 <= cp <= 0x4DBF
        mark = cat[0] == "P" or (33 <= cp <= 47 or 58 <= cp <= 64 or 91 <= cp <= 96 or 123 <= cp <= 126)
        blank = ch in "\t\n\r" or cat[0] == "Z"
        if han or mark:
            n += 1
            run = False
        elif blank:
            run = False
        else:
            n += not run
            run = True
    return n


def test_sizes_equal_a_plain_count():
    r = random.Random(1)
    alphabet = "订单，。 ab1\n\t​﻿é　$^�"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(300)] + [None, "", "a", "订" * 3, "x" * 5000, "hello, world", "a​b"]
    assert sizes(texts).tolist() == [brute_size(t) for t in texts]
    assert sizes([]).tolist() == []


def test_best_fit_takes_the_tightest_window():
    b = P.pack_pieces(np.array([70, 60, 30, 40]), np.array(["s"] * 4), np.arange(4), 100, 9)
    assert b[0] == b[2] and b[1] == b[3] and b[0] != b[1]


def test_copies_and_sources_conflict():
    b = P.pack_pieces(np.array([10, 10, 10, 10]), np.array(["s"] * 4), np.array([7, 7, 7, 1]), 100, 9)
    assert len(set(b[:3])) == 3
    b = P.pack_pieces(np.array([10] * 6), np.array(["s"] * 6), np.arange(6), 100, 2)
    assert max(np.bincount(b)) == 2


def packed(spark, rows, cap=100, **k):
    df = spark.createDataFrame(rows, "doc_id long, size long, source string, cluster long")
    return P.pack(df, spark.createDataFrame([("s", cap), ("bad", 0), (None, 5)], "spec string, capacity int"), Scratch(spark, "t"), **k)


def test_nothing_is_lost_and_only_oversize_is_divided(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(1, 400), "hot" if i % 3 == 0 else f"s{i % 11}", i % 900) for i in range(1000)] + [(5000, 0, "x", 1), (5001, None, None, None), (None, 5, "x", 1), (5002, 50, None, None)]
    out = packed(spark, rows, pieces_a_task=300).collect()
    got = {}
    for x in out:
        got.setdefault(x.doc_id, []).append(x)
        assert x.spec == "s"
    want = {i: s for i, s, *_ in rows if i is not None and s}
    assert {k: sum(x.tokens for x in v) for k, v in got.items()} == want
    for k, v in got.items():
        assert len(v) == -(-want[k] // 100) == v[0].pieces
        assert sorted((x.piece, x.start) for x in v) == [(j, 100 * j) for j in range(len(v))]
    fill = {}
    for x in out:
        fill[x.window] = fill.get(x.window, 0) + x.tokens
    assert max(fill.values()) <= 100 and sum(fill.values()) / (100 * len(fill)) > 0.95
    cluster = {i: c for i, _, _, c in rows}
    seen = set()
    for x in out:
        if x.pieces == 1:
            assert (x.window, cluster[x.doc_id]) not in seen or cluster[x.doc_id] is None
            seen.add((x.window, cluster[x.doc_id]))


def test_hot_cluster_spreads_over_tasks(spark):
    rows = [(i, 30, f"s{i % 5}", 1 if i % 3 == 0 else i) for i in range(1500)]
    out = packed(spark, rows, pieces_a_task=300)
    hot = out.where("doc_id % 3 = 0")
    assert hot.count() == 500 and hot.select("window").distinct().count() == 500
    assert hot.select(F.substring("window", 1, 6)).distinct().count() == 5
    assert packed(spark, []).count() == 0


def test_text_sizes_keep_rows(spark):
    df = spark.createDataFrame([(1, "订单 a"), (2, None), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in P.text_sizes(df, "text", ["doc_id"]).collect()) == [(1, 3), (2, 0), (2, 0)]


def test_exponent():
    p = [0.7, 0.2, 0.1]
    assert M.entropy(M.tempered(p, M.fit_exponent(p, target_entropy=1.0))) == pytest.approx(1.0, abs=1e-6)
    assert M.fit_exponent(p, target_entropy=9.0) == 0.0 or M.entropy(M.tempered(p, 0.0)) <= 9.0
    a = M.fit_exponent(p, room=[1.0, 0.3, 0.2])
    assert 0 < a < 1 and max(M.tempered(p, a)[1] - 0.3, M.tempered(p, a)[2] - 0.2) == pytest.approx(0, abs=1e-6)
    assert M.fit_exponent(p, room=[0.1, 0.1, 0.1]) == 1.0 and M.fit_exponent([], 1.0) == 1.0


def mixes(spark, docs, targets, mode="given"):
    d = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    t = spark.createDataFrame(targets, "mix_id string, source string, weight double, max_repeats int, total_tokens long")
    plan = M.plan_mixes(d.groupBy("source").agg(F.sum("tokens").alias("tokens")), t, mode)
    return plan, M.realise(d, plan)


def test_shares_repeats_and_shortfalls(spark):
    r = random.Random(6)
    docs = [(i, "hot" if i % 3 == 0 else f"s{i % 4}", r.randrange(1, 200)) for i in range(6000)] + [(9000, None, 5), (9001, "s1", 0)]
    own = {}
    for _, s, t in docs:
        own[s] = own.get(s, 0) + t
    total = 300_000
    plan, got = mixes(spark, docs, [("m", "hot", 0.5, 1, total), ("m", "s1", 0.3, 1, total), ("m", "s2", 0.2, 2, total), ("m", "gone", 0.0, 1, total), ("n", "hot", 1.0, 3, own["hot"] * 2 + 17), (None, "hot", 1.0, 1, 5)])
    rep = {(x.mix_id, x.source): x for x in M.mix_report(plan, got).collect()}
    for k, x in rep.items():
        assert x.most_uses <= x.max_repeats and abs(x.used - x.budget) <= 200, k
    short = {k for k, x in rep.items() if x.short > 0}
    assert short == {k for k, x in rep.items() if x.weight * x.total_tokens > x.max_repeats * own.get(x.source, 0)}
    assert rep["n", "hot"].most_uses in (2, 3) and rep["n", "hot"].documents == sum(1 for _, s, t in docs if s == "hot")
    assert got.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0


def test_temperature_meets_the_entropy(spark):
    docs = [(i, "abc"[i % 3 if i % 7 else 0], 10) for i in range(3000)]
    plan, got = mixes(spark, docs, [("m", "a", 0.4, 9, 9000), ("m", "b", 0.35, 9, 9000), ("m", "c", 0.25, 9, 9000)], "temperature")
    w = [x.weight for x in plan.collect()]
    assert M.entropy(w) == pytest.approx(M.entropy([0.4, 0.35, 0.25]), abs=1e-4) and sum(w) == pytest.approx(1.0)
    assert got.count() > 0 and mixes(spark, [], [("m", "a", 1.0, 1, 10)])[1].count() == 0


def test_temperature_beyond_one_and_without_a_fit(spark):
    docs = [(i, "a" if i < 60 else "b", 10) for i in range(100)]
    plan, _ = mixes(spark, docs, [("m", "a", 0.9, 9, 1000), ("m", "b", 0.1, 9, 1000), ("n", "a", 0.55, 1, 1500), ("n", "b", 0.45, 3, 1500)], "temperature")
    got = {(x.mix_id, x.source): x for x in plan.collect()}
    assert got["m", "a"].exponent > 1 and got["m", "a"].weight == pytest.approx(0.9, abs=1e-4) and got["m", "a"].met == "both"
    assert got["n", "a"].budget == pytest.approx(600) and got["n", "b"].budget == pytest.approx(900)
