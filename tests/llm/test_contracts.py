"""Every operator takes extra columns with clashing names, nulls in any column, repeated rows and empty tables."""

import pytest
from pyspark.sql import functions as F

from tarn.llm import consensus, mixing, neardup, packing, pairs, quality, sampling, splits
from tarn.storage import Scratch

CLASH = ["id", "key", "plain", "a", "b", "c", "n", "m", "v", "u", "w", "t", "k", "anchor", "links", "class", "group", "docs", "node", "label", "truth", "labels", "errors", "_id", "_key", "_bin", "_r", "_t", "_n", "_size", "_task", "piece", "tokens", "kind", "defect", "quota", "needed", "room", "passes", "left"]


def dirty(df, *used):
    extra = [c for c in CLASH if c.lower() not in {x.lower() for x in df.columns}]
    return df.select("*", *[F.lit("x").alias(c) for c in extra])


def both(df):
    """Full with rows repeated, and empty."""
    return [dirty(df.union(df)), dirty(df.limit(0))]


def s(spark):
    return Scratch(spark, "contract")


def test_pairs(spark):
    df = spark.createDataFrame([("1", "甲是什么？", "乙是一种东西。"), ("2", None, None), (None, None, None)], "case string, question string, answer string")
    full, none = both(df)
    assert {r.id for r in pairs.label_pairs(full, "case", "question", "answer", s(spark)).collect()} <= {"1", "2"}
    assert pairs.label_pairs(none, "case", "question", "answer", s(spark)).count() == 0


def test_neardup(spark):
    df = spark.createDataFrame([("1", "甲乙丙丁戊己庚辛", None), ("2", "甲乙丙丁戊己庚辛", None), ("3", None, None), (None, None, None)], "rid string, question string, answer string")
    full, none = both(df)
    got, links = neardup.near_duplicates(full, "rid", ["question", "answer"], s(spark))
    assert {r.id for r in got.collect()} == {"1", "2"} and links.count() == 0
    assert neardup.near_duplicates(none, "rid", ["question", "answer"], s(spark))[0].count() == 0


def test_consensus(spark):
    df = spark.createDataFrame([("1", "x", "pass", 1), ("1", "y", "pass", None), ("2", None, "fail", 1), (None, "x", "fail", 1), ("3", "x", None, 1)], "item string, labeller string, label string, at int")
    full, none = both(df)
    votes = consensus.holding_labels(full, ["item"])
    items, who = consensus.discover(votes, ["item"], s(spark))
    assert [r.item for r in items.collect()] == ["1"] and who.count() == 2
    assert consensus.agreement(votes, ["item"]).count() == 1
    assert consensus.discover(consensus.holding_labels(none, ["item"]), ["item"], s(spark))[0].count() == 0
    odd = spark.createDataFrame([("1", "x", "pass"), ("1", "y", "fail")], "c string, labeller string, label string")
    assert consensus.agreement(odd, ["c"]).first().items == 1


def test_splits(spark):
    df = spark.createDataFrame([("1", ["p", None]), ("2", ["p"]), ("3", None), (None, ["p"])], "rid string, papers array<string>")
    full, none = both(df)
    g = splits.related_groups(full, "rid", F.col("papers"), s(spark))
    assert g.select("group").distinct().count() == 2
    t = spark.createDataFrame([("train", 1.0, "x")], "split_name string, share double, rows string")
    grouped = g.withColumns({"split": F.lit("dev"), "lo": F.lit(1), "n": F.lit(1), "new_split": F.lit("y")})
    assert splits.torn_groups(grouped).count() == 0
    assert splits.assign_splits(grouped.drop("new_split"), t)[0].count() == 3
    assert splits.related_groups(none, "rid", F.col("papers"), s(spark)).count() == 0


def test_sampling(spark):
    items = spark.createDataFrame([("1", "x"), ("2", None), (None, "x")], "rid string, type string")
    plan = spark.createDataFrame([("p", "x", 1.0, 0, 1), ("p", None, None, None, None)], "plan_id string, type string, share double, min_rows int, sample_rows int")
    have = spark.createDataFrame([("x", 1)], "type string, rows long")
    d = sampling.quotas(dirty(have), dirty(plan), ["type"])
    assert d.where("type = 'x'").first().quota == 1
    assert [r.rid for r in sampling.draw(dirty(items), "rid", ["type"], d).collect()] == ["1"]
    assert sampling.draw(dirty(items.limit(0)), "rid", ["type"], d).count() == 0


def test_packing(spark):
    items = spark.createDataFrame([(1, 5, "x", 1), (2, None, None, None), (None, 3, "x", 1), (3, 25, None, None)], "doc_id long, size long, source string, cluster long")
    spec = spark.createDataFrame([("s", 10), ("n", None)], "spec string, capacity int")
    out = packing.pack(dirty(items), dirty(spec), s(spark))
    assert {r.doc_id: r.pieces for r in out.collect()} == {1: 1, 3: 3}
    assert packing.pack_report(out).first().tokens == 30
    assert packing.pack(dirty(items.limit(0)), spec, s(spark)).count() == 0
    text = dirty(spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string"))
    assert sorted(r.size for r in packing.text_sizes(text, "text", ["doc_id"], out="size").collect()) == [0, 2]


def test_mixing(spark):
    docs = spark.createDataFrame([(1, "x", 5), (2, None, 5), (3, "x", None), (None, "x", 5)], "doc_id long, source string, tokens long")
    t = spark.createDataFrame([("m", "x", 1.0, 1, 5), ("m", None, 1.0, 1, 5), ("m", "y", None, None, None)], "mix_id string, source string, weight double, max_repeats int, total_tokens long")
    sizes = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    p = mixing.plan_mixes(dirty(sizes), dirty(t))
    assert p.where("short > 0").count() == 0
    assert mixing.mix_report(p, mixing.realise(dirty(docs), p)).where("source = 'x'").first().used in (5, 10)


def test_quality(spark):
    df = spark.createDataFrame([(1, "这是一句话。"), (1, "这是一句话。"), (None, None)], "doc_id long, text string")
    assert quality.text_statistics(dirty(df), "doc_id", "text").count() == 3


@pytest.mark.parametrize("extra", ["group", "component", "node"])
def test_components_ignore_other_columns(spark, extra):
    from tarn.llm.components import hash_to_min

    e = spark.createDataFrame([(1, 2, "x")], f"a int, b int, `{extra}` string")
    assert hash_to_min(e, s(spark)).count() == 2
