import random

import pytest
from pyspark.sql import functions as F

from tarn.llm.consensus import agreement, chi2_quantile, discover, holding_labels, verdict
from tarn.storage import Scratch


@pytest.mark.parametrize(("q", "n", "x"), [(0.025, 1, 0.000982), (0.025, 10, 3.24697), (0.975, 10, 20.4832), (0.025, 100, 74.2219), (0.025, 6000, 5787.2)])
def test_chi_squared(q, n, x):
    assert chi2_quantile(q, n) == pytest.approx(x, rel=1e-3)


def test_spellings(spark):
    v = ["pass", " PASS。", "通过", "合格", "failed", "不通过", "FAIL。", "pass\n", "unsure", "存疑", "", None, "n/a"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v string").select(verdict(F.col("v"))).collect()]
    assert got == ["pass"] * 4 + ["fail"] * 3 + ["pass"] + [None] * 5


def test_the_later_label_holds(spark):
    rows = [("i", "a", "pass", 1), ("i", "a", "fail", 2), ("i", "a", None, 3), ("i", "b", "pass", 1), ("i", "b", "pass", 1), (None, "a", "pass", 1), ("i", None, "pass", 1)]
    d = holding_labels(spark.createDataFrame(rows, "id string, labeller string, label string, at int"), ["id"])
    assert sorted(tuple(r) for r in d.collect()) == [("i", "a", "fail"), ("i", "b", "pass")]


def crowd(seed, items=400):
    r = random.Random(seed)
    good = {f"g{i}": 0.92 for i in range(3)} | {"m": 0.75, "random1": 0.5, "random2": 0.5, "liar": 0.25}
    rows, truth = [], {}
    for i in range(items):
        truth[i] = t = "fail" if r.random() < 0.3 else "pass"
        other = {"fail": "pass", "pass": "fail"}
        for k, p in good.items():
            if r.random() < (0.6 if k[0] == "g" else 0.9):
                rows.append((i, k, t if r.random() < p else other[t]))
        rows.append((i, "yes", "pass"))
    return rows, truth


def test_better_than_the_majority(spark):
    rows, truth = crowd(5)
    v = spark.createDataFrame(rows, "id int, labeller string, label string")
    items, labellers = discover(v, ["id"], Scratch(spark, "t"))
    got = {r.id: r.label for r in items.collect()}
    right = sum(got[i] == t for i, t in truth.items()) / len(truth)
    votes = {}
    for i, _, y in rows:
        votes.setdefault(i, []).append(y)
    plain = sum((("fail" if v.count("fail") * 2 >= len(v) else "pass") == truth[i]) for i, v in votes.items()) / len(truth)
    assert right > plain + 0.05 and right > 0.9
    w = {r.labeller: r for r in labellers.collect()}
    assert min(w[k].weight for k in ("g0", "g1", "g2")) > w["m"].weight > 0.1
    assert max(w[k].weight for k in ("random1", "random2", "liar", "yes")) < 0.3
    assert w["yes"].labels == len(truth)


def test_a_small_record_weighs_less(spark):
    rows = [(i, k, "pass" if i % 3 else "fail") for i in range(200) for k in ("a", "b", "c")] + [(i, "new", "pass" if i % 3 else "fail") for i in range(5)]
    _, labellers = discover(spark.createDataFrame(rows, "id int, labeller string, label string"), ["id"], Scratch(spark, "t"))
    w = {r.labeller: r.weight for r in labellers.collect()}
    assert w["new"] < w["a"]


def test_ties_single_labels_and_nothing(spark):
    rows = [(1, "a", "pass"), (1, "b", "fail"), (2, "a", "pass")]
    items, _ = discover(spark.createDataFrame(rows, "id int, labeller string, label string"), ["id"], Scratch(spark, "t"))
    got = {r.id: (r.label, r.labels) for r in items.collect()}
    assert got == {1: ("fail", 2), 2: ("pass", 1)}
    items, labellers = discover(spark.createDataFrame([], "id int, labeller string, label string"), ["id"], Scratch(spark, "t"))
    assert items.count() == 0 and labellers.count() == 0


def test_hot_item(spark):
    rows = [(0, f"w{i:04d}", "pass" if i % 10 else "fail") for i in range(1500)] + [(1 + i // 3, f"w{i % 1500:04d}", "fail") for i in range(3000)]
    items, labellers = discover(spark.createDataFrame(rows, "id int, labeller string, label string").dropDuplicates(["id", "labeller"]), ["id"], Scratch(spark, "t"))
    assert {r.label for r in items.where("id = 0").collect()} == {"pass"} and labellers.count() == 1500


def test_alpha(spark):
    same = spark.createDataFrame([(i, k, "pass" if i % 2 else "fail") for i in range(10) for k in "ab"], "id int, labeller string, label string")
    assert agreement(same, ["id"]).first().alpha == pytest.approx(1.0)
    one = spark.createDataFrame([(1, "a", "pass"), (1, "b", "pass")], "id int, labeller string, label string")
    assert agreement(one, ["id"]).first().alpha is None
    # two coders, ten items: six both a, two both b, two split
    rows = [(i, "a") for i in range(8) for _ in range(1)]
    rows = [(i, k, "a") for i in range(6) for k in "xy"] + [(i, k, "b") for i in (6, 7) for k in "xy"] + [(8, "x", "a"), (8, "y", "b"), (9, "x", "b"), (9, "y", "a")]
    got = agreement(spark.createDataFrame(rows, "id int, labeller string, label string"), ["id"]).first()
    assert got.alpha == pytest.approx(1 - 0.2 / ((400 - 14**2 - 6**2) / (20 * 19)))


@pytest.mark.parametrize("q", [0.001, 0.025, 0.1, 0.5, 0.9, 0.975])
def test_quantiles_go_on_smoothly(q):
    steps = [chi2_quantile(q, n + 1) - chi2_quantile(q, n) for n in (998, 999, 1000, 1001, 1002, 4999, 5000)]
    assert max(steps[:5]) - min(steps[:5]) < 1e-3 and all(0.8 < s < 1.2 for s in steps)


def test_crowded_items_give_the_same(spark, monkeypatch):
    import random

    from tarn.llm import consensus

    r = random.Random(1)
    rows = [("hot", f"w{k}", "fail" if r.random() < 0.7 else "pass") for k in range(60)] + [(f"i{i}", f"w{k}", "fail" if (i % 4 == 0) != (r.random() < 0.1 + k / 100) else "pass") for i in range(60) for k in r.sample(range(60), 5)]
    v = spark.createDataFrame(rows, "item string, labeller string, label string")
    get = lambda: {x.item: (x.label, x.labels, round(x.support, 9)) for x in discover(v, ["item"], Scratch(spark, "t"))[0].collect()}
    whole = get()
    monkeypatch.setattr(consensus, "VOTES_A_TASK", 7)
    assert get() == whole and whole["hot"][0] == "fail"
