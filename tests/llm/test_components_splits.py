import random

import pytest
from pyspark.sql import functions as F

from tarn.llm import _items as I
from tarn.llm.components import hash_to_min
from tarn.llm.splits import assign_splits, related_groups, torn_groups
from tarn.storage import Scratch


def brute(edges):
    p = {}

    def f(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in edges:
        x, y = f(a), f(b)
        p[max(x, y)] = min(x, y)
    return {x: f(x) for x in p}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 300)], [(5, 5)], [(r.randrange(200), r.randrange(200)) for r in [random.Random(1)] for _ in range(150)], [(1, 2), (1, 2), (2, 1)]])
def test_components_equal_union_find(spark, edges):
    df = spark.createDataFrame(edges, "a int, b int")
    got = {r.node: r.component for r in hash_to_min(df, Scratch(spark, "t")).collect()}
    assert got == brute(edges)


def test_components_of_nothing_and_nulls(spark):
    df = spark.createDataFrame([(None, 1), (2, None)], "a int, b int")
    assert hash_to_min(df, Scratch(spark, "t")).count() == 0


def test_plain_spellings(spark):
    rows = spark.createDataFrame([(" order_B１００２.txt",), ("data/x/policy_1.md",), ("（库外语料）",), ("(库外语料) ",), ("",), (None,), ("ORDER-B1002",)], "d string")
    assert [r[0] for r in rows.select(I.document_id(F.col("d"))).collect()] == ["order_b1002", "policy_1", None, None, None, None, "order_b1002"]
    s = spark.createDataFrame([("hold-out",), (" Dev",), ("",), (None,)], "s string")
    assert [r[0] for r in s.select(I.split_name(F.col("s"))).collect()] == ["holdout", "dev", None, None]
    w = spark.createDataFrame([("Multi-Hop ",), ("多跳",), (" ",)], "w string")
    assert [r[0] for r in w.select(I.word(F.col("w"), I.TYPE_NAMES)).collect()] == ["multi_hop", "multi_hop", None]


def groups(spark, rows):
    df = spark.createDataFrame(rows, "id string, docs array<string>")
    return {r.id: r.group for r in related_groups(df, "id", F.col("docs"), Scratch(spark, "t")).collect()}


def test_groups_through_documents(spark):
    g = groups(spark, [("1", ["a", "b"]), ("2", ["b", "c"]), ("3", ["d"]), ("4", ["d", None]), ("5", []), ("6", None), (None, ["a"]), ("7", ["c"]), ("3", ["d"])])
    assert g["1"] == g["2"] == g["7"] == "doc:a" and g["3"] == g["4"] == "doc:d" and g["5"] == "item:5" and g["6"] == "item:6" and len(g) == 7


def test_repeated_ids_unite_their_documents(spark):
    g = groups(spark, [("1", ["a"]), ("1", ["b"]), ("2", ["b"])])
    assert g == {"1": "doc:a", "2": "doc:a"}
    assert groups(spark, []) == {}


def test_hot_document_and_torn_groups(spark):
    rows = [(f"i{i}", ["hub"]) for i in range(400)] + [(f"j{i}", [f"d{i}"]) for i in range(600)]
    g = groups(spark, rows)
    assert len({v for k, v in g.items() if k[0] == "i"}) == 1
    df = spark.createDataFrame([(k, v, "dev" if k == "i0" else None if k == "i1" else "holdout") for k, v in g.items()], "id string, `group` string, split string")
    torn = {r.id for r in torn_groups(df).collect()}
    assert torn == {k for k in g if k[0] == "i"}


def test_assignment_keeps_groups_and_shares(spark):
    rows = [(f"a{i}", "hot") for i in range(3000)] + [(f"b{i}", f"g{i // 3}") for i in range(6000)]
    df = spark.createDataFrame(rows, "id string, `group` string")
    t = spark.createDataFrame([("train", 0.7), ("validation", 0.15), ("test", 0.15), ("none", None), ("zero", 0.0)], "split_name string, share double")
    out, rep = assign_splits(df, t)
    assert out.count() == 9000 and out.groupBy("group").agg(F.count_distinct("new_split").alias("n")).where("n > 1").count() == 0
    assert {r.split_name for r in rep.collect()} == {"train", "validation", "test"}
    assert all(abs(r.reached - r.share) < 0.02 for r in rep.collect())
    again = {r.id: r.new_split for r in assign_splits(df, t)[0].collect()}
    assert again == {r.id: r.new_split for r in out.collect()}
    none, rep = assign_splits(df.limit(0), t)
    assert none.count() == 0 and rep.count() == 0


def test_a_group_stays_when_others_come(spark):
    t = spark.createDataFrame([("train", 0.7), ("validation", 0.15), ("test", 0.15)], "split_name string, share double")
    few = spark.createDataFrame([(f"b{i}", f"g{i // 3}") for i in range(600)], "id string, `group` string")
    many = few.union(spark.createDataFrame([(f"c{i}", f"h{i // 50}") for i in range(3000)], "id string, `group` string"))
    first, rep = assign_splits(few, t)
    later, both = assign_splits(many, t, kept=first)
    later = {r.id: r.new_split for r in later.collect()}
    assert all(later[r.id] == r.new_split for r in first.collect())
    assert all(abs(r.reached - r.share) < 0.02 for r in [*rep.collect(), *both.collect()])


@pytest.mark.parametrize("hot", [3, 2_000_000])
def test_components_with_hot_nodes(spark, monkeypatch, hot):
    from tarn.llm import components

    monkeypatch.setattr(components, "HOT_ROWS", hot)
    rows = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (None, 3), (300, 301)]
    got = {r.node: r.component for r in hash_to_min(spark.createDataFrame(rows, "a int, b int"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)} | {300: 300, 301: 300}
