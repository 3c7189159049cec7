import pytest
from pyspark.sql import functions as F

from tarn.llm.sampling import draw, quotas, report

K = ["type", "difficulty"]


def dealt(spark, have, plan):
    h = spark.createDataFrame(have, "type string, difficulty string, rows long")
    p = spark.createDataFrame(plan, "plan_id string, type string, difficulty string, share double, min_rows int, sample_rows long")
    return {(r.plan_id, r.type): r for r in quotas(h, p, K).collect()}


def test_largest_remainder(spark):
    d = dealt(spark, [("a", "x", 100), ("b", "x", 100), ("c", "x", 100)], [("p", "a", "x", 0.5, 0, 7), ("p", "b", "x", 0.3, 0, 7), ("p", "c", "x", 0.2, 0, 7)])
    assert [d["p", t].quota for t in "abc"] == [4, 2, 1] and all(r.shortfall == 0 for r in d.values())


def test_floors_caps_and_shortfalls(spark):
    d = dealt(spark, [("a", "x", 3), ("b", "x", 100)], [("p", "a", "x", 0.5, 0, 10), ("p", "b", "x", 0.4, 0, 10), ("p", "c", "x", 0.1, 2, 10)])
    assert (d["p", "a"].quota, d["p", "b"].quota, d["p", "c"].quota) == (3, 7, 0)
    assert d["p", "a"].shortfall == 2.0 and d["p", "c"].shortfall == 2.0 and d["p", "b"].shortfall == 0.0
    d = dealt(spark, [("a", "x", 50), ("b", "x", 50)], [("p", "a", "x", 0.99, 0, 10), ("p", "b", "x", 0.01, 4, 10)])
    assert (d["p", "a"].quota, d["p", "b"].quota) == (6, 4)


def test_nulls_repeats_and_nothing(spark):
    d = dealt(spark, [("a", "x", 5)], [("p", "a", "x", None, None, 10), ("q", "a", "x", 0.5, 1, 4), ("q", "a", "x", 0.5, 2, 4)])
    assert d["p", "a"].quota == 0 and d["q", "a"].quota == 4
    assert dealt(spark, [], []) == {}


def test_draw_is_exact_deterministic_and_nested(spark):
    items = spark.range(30000).select(F.concat(F.lit("i"), "id").alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("type"), F.lit("x").alias("difficulty"), F.lit(1).alias("quota"))
    p = spark.createDataFrame([("p", "hot", "x", 777), ("q", "hot", "x", 10000), ("q", "t1", "x", 5), ("r", "hot", "x", 100)], "plan_id string, type string, difficulty string, quota long")
    got = draw(items.drop("quota"), "id", K, p)
    n = {(r.plan_id, r.type): r["count"] for r in got.groupBy("plan_id", "type").count().collect()}
    assert n == {("p", "hot"): 777, ("q", "hot"): 10000, ("q", "t1"): 5, ("r", "hot"): 100}
    ids = {k: {r.id for r in got.where(f"plan_id = '{k}' and type = 'hot'").collect()} for k in "pqr"}
    assert ids["r"] < ids["p"] < ids["q"]
    assert {r.id for r in draw(items.drop("quota").repartition(7), "id", K, p).where("plan_id = 'p'").collect()} == ids["p"]


def test_report_reaches_the_shares(spark):
    items = spark.createDataFrame([(f"i{i}", "a" if i % 2 else "b", "x") for i in range(200)] + [("n", None, "x")], "id string, type string, difficulty string")
    h = items.dropna().groupBy(*K).agg(F.count("*").alias("rows"))
    p = spark.createDataFrame([("p", "a", "x", 0.25, 0, 40), ("p", "b", "x", 0.75, 0, 40)], "plan_id string, type string, difficulty string, share double, min_rows int, sample_rows long")
    d = quotas(h, p, K)
    r = {x.type: x for x in report(d, draw(items, "id", K, d), K).collect()}
    assert r["a"].drawn == 10 and r["b"].drawn == 30 and r["a"].reached_share == pytest.approx(0.25)
