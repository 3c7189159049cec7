import pytest
from pyspark.sql import functions as F

from tarn.functions import stats as S
from tarn.operators import curation as Q
from tarn.operators import evaluation as E
from tarn.storage import Scratch


def test_wilson(spark):
    r = spark.createDataFrame([(12, 52), (36, 52), (0, 0)], "k int, n int")
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    assert [tuple(x) for x in r.select(lo, hi).collect()] == [(0.1372, 0.3613), (0.5573, 0.8009), (0.0, 1.0)]


@pytest.mark.parametrize(("b", "c", "chi2", "p"), [(8, 1, 4.0, 0.0455), (6, 1, 2.2857, 0.1306), (7, 0, 5.1429, 0.0233), (3, 5, 0.125, 0.7237), (1, 1, 0.5, 0.4795), (2, 1, 0.0, 1.0), (0, 0, 0.0, 1.0)])
def test_mcnemar(spark, b, c, chi2, p):
    r = spark.range(1).select(S.mcnemar(F.lit(b), F.lit(c)).alias("x")).select("x", F.round(S.chi2_p("x"), 4)).first()
    assert tuple(r) == (chi2, p)


def test_kappa_and_percentile(spark):
    k = spark.range(1).select(S.kappa(F.lit(9), F.lit(0), F.lit(3), F.lit(44)).alias("k"), S.kappa(F.lit(5), F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert round(k.k, 3) == 0.825 and k.none is None
    assert spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double").agg(S.percentile(F.col("x"), 0.5)).first()[0] == 2.5


def test_calibration_counts(spark):
    rows = [("fail", "fail")] * 9 + [("pass", "pass")] * 44 + [("pass", "fail")] * 3 + [("pass", None), ("unsure", "pass")]
    r = E.calibrate(spark.createDataFrame(rows, "human string, judge string")).first()
    assert (r.n, r.tp, r.fn, r.tn, r.fp) == (56, 9, 0, 44, 3) and r.agreement == 0.9464 and r.kappa == 0.825


def judged(spark, *rows):
    s = "type string, judge map<string,string>, support array<string>, context_docs array<string>, fused_docs array<string>, refused boolean, hyde_used boolean, invalid_markers array<int>"
    return [r.attribution for r in E.attribute(spark.createDataFrame(rows, s)).collect()]


def test_attribution_order(spark):
    ac, cit, ok = {"answer_correctness": "fail"}, {"citation_accuracy": "fail"}, {"answer_correctness": "pass"}
    got = judged(
        spark,
        ("factual", ok, ["a"], [], [], False, False, []),
        ("factual", cit, ["a"], [], [], False, False, []),
        ("factual", ac, ["a"], ["a"], ["a"], True, False, []),
        ("adversarial", ac, ["a"], [], ["a"], True, False, []),
        ("factual", ac, ["a", "b"], ["a"], ["a"], False, True, []),
        ("factual", ac, ["a", "b"], ["a"], ["a", "b"], False, False, []),
        ("factual", ac, ["a"], ["a"], ["a"], False, False, []),
        ("factual", ac, [], [], [], True, False, []),
    )
    assert got == ["无问题", "citation_error", "generation_synthesis_failure", "premise_not_corrected", "retrieval_miss.not_recalled", "retrieval_miss.ranked_below_cutoff", "omission", "generation_synthesis_failure"]


def test_criteria(spark):
    r = spark.createDataFrame([("quality", "answer", None), ("quality", "refuse", None), ("safety", "ignore_injection", "injection_doc"), ("safety", "refuse", "harmful"), ("safety", "refuse", "boundary")], "s string, b string, t string")
    got = [x[0] for x in r.select(E.criteria(F.col("s"), F.col("b"), F.col("t"))).collect()]
    assert [len(x) for x in got] == [3, 1, 1, 1, 1] and got[2:] == [["injection_resistance"], ["harmful_refusal"], ["boundary_compliance"]]


def test_every_kth_over_many_partitions(spark):
    df = spark.range(1000).repartition(7)
    assert sorted(r.id for r in E.every_kth(df, 9, ["id"]).collect()) == list(range(0, 1000, 9))


def test_near_fingerprints_lose_none(spark):
    import random

    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = base + [b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base] + base[:3]
    rows = [(i, f - ((f >> 63) << 64)) for i, f in enumerate(fps)]
    got = {tuple(x) for x in Q.near_fingerprints(spark.createDataFrame(rows, "id int, fp long"), "id", "fp").collect()}
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(f, i)
    want = {(i, j) for i in set(first.values()) for j in set(first.values()) if i < j and (fps[i] ^ fps[j]).bit_count() <= 3} | {(first[f], i) for i, f in enumerate(fps) if first[f] != i}
    assert got == want


def test_question_checks_keep_the_first(spark):
    rows = [("a", "factual", "订单什么时候能够发货呢？"), ("b", "factual", "订单 什么时候能够发货呢"), ("c", "factual", ""), ("d", "factual", "短"), ("e", "factual", "what is the price of it"), ("f", "out_of_scope", "what is the price of it"), ("g", None, None)]
    df = spark.createDataFrame(rows, "id string, type string, question string")
    got = {r.id: r.reason for r in Q.question_checks(df).collect()}
    assert got == {"a": None, "b": "duplicate_exact", "c": "empty", "d": "length", "e": "han_ratio", "f": None, "g": "empty"}


def test_upsert_prefers_later_then_new(spark):
    s = "k string, v string, t int"
    old, new = spark.createDataFrame([("a", "1", 5), ("b", "1", 5)], s), spark.createDataFrame([("a", "2", 5), ("b", "2", 4), ("c", "2", 1)], s)
    assert sorted((r.k, r.v) for r in Q.upsert(old, new, ["k"], "t").collect()) == [("a", "2"), ("b", "1"), ("c", "2")]


def test_parity(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "k int, v string")
    assert tuple(Q.parity(a, b, ["k"], "v").first()) == (2, 3, 2, 1)


def test_round_robin_is_balanced(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(12)], "id int, t string")
    n = [r["count"] for r in Q.round_robin(df, 3, "t", "id").groupBy("bucket").count().collect()]
    assert sorted(n) == [4, 4, 4]


def test_near_questions_are_compared_with_accepted_ones_only(spark):
    rows = [(i, f) for i, f in enumerate([0b0, 0b111, 0b111111, 0b1111 << 40, 0b111111111])]
    df = spark.createDataFrame(rows, "id int, fp long")
    near = Q.near_fingerprints(df.select(F.col("fp").alias("k"), "fp"), "k", "fp")
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    got = {r.id for r in Q.accepted_in_order(df, near, Scratch(spark, "t")).collect()}
    kept = []  # the loop of the definition
    for i, f in rows:
        if all((f ^ g).bit_count() > 3 for _, g in kept):
            kept.append((i, f))
    assert got == {i for i, _ in kept} == {0, 2, 3}


def test_repeats_of_a_rejected_question_stay(spark):
    q = "请问这款净水器的滤芯应该多久更换一次呢"
    df = spark.createDataFrame([("a", "factual", q, q), ("b", "factual", q, "无关的资料"), ("c", "factual", q, "无关的资料")], "id string, type string, question string, p string")
    assert {r.id: r.reason for r in Q.question_checks(df, F.col("p")).collect()} == {"a": "leak", "b": None, "c": "duplicate_exact"}


def test_badcase_gates(spark):
    q = "".join(chr(0x4E00 + i * 7) for i in range(400))
    new = [("k", q, "x"), ("n0", q + "？", "x"), ("n1", q + "呀", "x"), ("n2", "保修期从哪一天开始计算才对呢", "保修期从哪一天开始计算才对呢"), ("n3", "运费由谁来承担", "x"), ("n4", "发票抬头可以修改吗", "x"), ("n5", None, "x"), ("z", "已知但没有问题", "x")]
    df = spark.createDataFrame([(i, "factual", t, "x", ["c"], ["d"], "answer", p, "无问题" if i == "z" else None) for i, t, p in new], "id string, type string, question string, ground_truth string, key_claims array<string>, supporting_docs array<string>, expected_behavior string, p string, attribution string")
    known = spark.createDataFrame([("k", q), ("z", "另一个已知的题目")], "id string, question string")
    want = {"k": "regression", "n0": "duplicate_exact", "n1": "duplicate_near", "n2": "leakage", "n3": "accepted", "n4": "accepted", "n5": "missing_question"}
    assert {r.id: r.outcome for r in Q.badcase_gates(df, known, F.col("p")).collect()} == want
    assert {r.id: r.outcome for r in Q.badcase_gates(df, known, F.col("p"), 1).collect()} == want | {"n4": "quota_full"}
