"""Queries of the training-data problems, over their whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import _items as I
from tarn.llm.oracles import ORACLE  # noqa: F401
from tarn.session import settle
from tarn.storage import Scratch


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- 3: consensus ---------------------------------------------------------------------------


def votes(spark: SparkSession, sf: str) -> DataFrame:
    from tarn.llm.consensus import holding_labels, verdict

    c, j = _read(spark, sf, "calibration"), _read(spark, sf, "judge_spotcheck_v1")
    row = lambda who, what, at: F.struct(who.alias("labeller"), verdict(what).alias("label"), at.alias("at"))
    at = F.col("labelled_at")
    of_c = c.select("id", "criterion", F.explode(F.array(row(F.col("annotator"), F.col("human.label"), at), row(F.col("judge.model"), F.col("judge.verdict"), at), row(F.col("judge2.model"), F.col("judge2.verdict"), at))).alias("r"))
    at = F.col("checked_at")
    of_j = j.select("id", "criterion", F.explode(F.array(row(F.col("reviewer"), F.col("human_verdict"), at), row(F.col("judge_model"), F.col("judge_verdict"), at))).alias("r"))
    return holding_labels(of_c.union(of_j).select("id", "criterion", "r.*"), ["id", "criterion"])


def _discovered(spark: SparkSession, sf: str, scratch: Scratch):
    from tarn.llm.consensus import discover

    return discover(votes(spark, sf), ["id", "criterion"], scratch)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "p3")
    items, _ = _discovered(spark, sf, scratch)
    return scratch.finish(items.where("label = 'fail'").select("id", "criterion"))


def p3_consensus(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "p3")
    return scratch.finish(_discovered(spark, sf, scratch)[0])


def p3_reliability(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "p3")
    return scratch.finish(_discovered(spark, sf, scratch)[1])


def p3_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Items with labels, their labels, items whose labellers all agree, and how many of these have another consensus."""
    c = p3_consensus(spark, sf)
    v = votes(spark, sf).groupBy("id", "criterion").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    j = v.join(c, ["id", "criterion"], "left")
    same = F.col("lo") == F.col("hi")
    return j.agg(F.count("label").alias("items"), F.sum("labels").alias("labels"), F.count_if(same).alias("agreed"), F.count_if(same & (F.coalesce("label", F.lit("")) != F.col("lo"))).alias("against"))


def p3_agreement(spark: SparkSession, sf: str) -> DataFrame:
    from tarn.llm.consensus import agreement

    return agreement(votes(spark, sf), ["id", "criterion"], by=["criterion"])


# --- 4: splits ------------------------------------------------------------------------------


def _grouped(spark: SparkSession, sf: str, scratch: Scratch) -> DataFrame:
    from tarn.llm.splits import related_groups

    b = _read(spark, sf, "business_v1").select("id", "split", "supporting_docs")
    plain = F.array_compact(F.transform("supporting_docs", I.document_id))
    rows = scratch.cut(b.where("id is not null").select("id", I.split_name(F.col("split")).alias("split"), plain.alias("docs")), "rows")
    groups = related_groups(rows, "id", F.col("docs"), scratch)
    return scratch.cut(rows.groupBy("id").agg(F.max("split").alias("split")).join(groups, "id"), "grouped")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from tarn.llm.splits import torn_groups

    scratch = Scratch(spark, "p4")
    return scratch.finish(torn_groups(_grouped(spark, sf, scratch)).select("id"))


def _assigned(spark: SparkSession, sf: str, which: int) -> DataFrame:
    from tarn.llm.splits import assign_splits

    scratch = Scratch(spark, "p4")
    return scratch.finish(assign_splits(_grouped(spark, sf, scratch), _read(spark, sf, "split_targets"))[which])


def p4_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf, 0)


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf, 1)


def p4_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Items and groups of the assignment, groups in two splits, and whether each split has its share to within a hundredth."""
    a = p4_assignment(spark, sf)
    per = a.groupBy("group").agg(F.count("*").alias("n"), F.count_distinct("new_split").alias("k")).agg(F.sum("n").alias("items"), F.count("*").alias("groups"), F.count_if(F.col("k") > 1).alias("torn"))
    got = a.groupBy(F.col("new_split").alias("split_name")).agg(F.count("*").alias("rows"))
    off = _read(spark, sf, "split_targets").join(got, "split_name", "left").select("share", F.coalesce("rows", F.lit(0)).alias("rows"))
    shares = off.agg(F.collect_list("share").alias("s"), F.collect_list("rows").alias("r"), F.sum("rows").alias("t"))  # a row for each split
    ok = shares.select(F.forall(F.zip_with("s", F.transform("r", lambda x: x / F.col("t")), lambda x, y: F.abs(x - y) <= 0.01), lambda x: x).alias("reached"))
    return per.crossJoin(ok)  # one row each


# --- 5: samples -----------------------------------------------------------------------------

_KEYS = ["type", "difficulty"]


def _categories(spark: SparkSession, sf: str) -> DataFrame:
    b = _read(spark, sf, "business_v1").select("id", I.word(F.col("type"), I.TYPE_NAMES).alias("type"), I.word(F.col("difficulty"), I.DIFFICULTY_NAMES).alias("difficulty"), "loaded_at")
    return I.once(b, "id", *_KEYS, latest="loaded_at")


def _dealt(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from tarn.llm.sampling import quotas

    items = _categories(spark, sf)
    have = items.dropna(subset=_KEYS).groupBy(*_KEYS).agg(F.count("*").alias("rows"))
    return items, quotas(have, _read(spark, sf, "sample_plan"), _KEYS)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _dealt(spark, sf)[1].where("shortfall > 0").select("plan_id", *_KEYS)


def p5_sample(spark: SparkSession, sf: str) -> DataFrame:
    from tarn.llm.sampling import draw

    items, dealt = _dealt(spark, sf)
    return draw(items, "id", _KEYS, dealt)


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    from tarn.llm.sampling import draw, report

    items, dealt = _dealt(spark, sf)
    return report(dealt, draw(items, "id", _KEYS, dealt), _KEYS)


def p5_shortfalls(spark: SparkSession, sf: str) -> DataFrame:
    d = _dealt(spark, sf)[1]
    return d.select("plan_id", *_KEYS, "available", F.round("needed", 6).alias("needed"), F.round("shortfall", 6).alias("shortfall"))


def p5_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Items of each plan's sample; categories below their minimum though there are items; items drawn twice; items of a category other than planned."""
    from tarn.llm.sampling import draw

    items, dealt = _dealt(spark, sf)
    drawn = draw(items, "id", _KEYS, dealt)
    n = drawn.groupBy("plan_id", *_KEYS).agg(F.count("*").alias("k"), (F.count("*") - F.count_distinct("id")).alias("twice"))
    real = drawn.join(items.select("id", F.col("type").alias("_t"), F.col("difficulty").alias("_d")), "id").where("type <> _t or difficulty <> _d").groupBy("plan_id").agg(F.count("*").alias("other"))
    j = dealt.join(n, ["plan_id", *_KEYS], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    g = j.groupBy("plan_id").agg(F.sum("k").cast("long").alias("drawn"), F.count_if(F.col("k") < F.least("min_rows", "available")).alias("below_minimum"), F.sum(F.coalesce("twice", F.lit(0))).cast("long").alias("twice"))
    return g.join(real, "plan_id", "left").select("plan_id", "drawn", "below_minimum", "twice", F.coalesce("other", F.lit(0).cast("long")).alias("of_other_categories"))


# --- 1: pairs -------------------------------------------------------------------------------


def p1_labels(spark: SparkSession, sf: str) -> DataFrame:
    from tarn.llm.pairs import label_pairs

    pairs = _read(spark, sf, "spotcheck_20261013_003").select("case_id", "question", "answer")
    scratch = Scratch(spark, "p1")
    return scratch.finish(label_pairs(pairs, "case_id", "question", "answer", scratch).withColumnRenamed("id", "case_id"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_labels(spark, sf).where("main").select("case_id", "defect")


# --- 2: near-duplicates ---------------------------------------------------------------------


def _near(spark: SparkSession, sf: str, scratch: Scratch, exact: bool = False):
    from tarn.llm.neardup import near_duplicates

    b = _read(spark, sf, "business_v1").select("id", "question", "ground_truth", "loaded_at")
    b = I.once(b, "id", "question", "ground_truth", latest="loaded_at")
    return near_duplicates(b, "id", ["question", "ground_truth"], scratch, exact)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    from tarn.llm.neardup import class_pairs

    scratch = Scratch(spark, "p2")
    return scratch.finish(class_pairs(_near(spark, sf, scratch)[0]))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Classes with every link, those that the anchors leave to the prefix filter too."""
    scratch = Scratch(spark, "p2")
    return scratch.finish(_near(spark, sf, scratch, exact=True)[0])


# --- 6: windows -----------------------------------------------------------------------------


def _sized(spark: SparkSession, sf: str, scratch: Scratch) -> DataFrame:
    """Documents with size, plain source and a hash of their text as duplicate cluster, written once."""
    from tarn.llm.packing import text_sizes

    d = _read(spark, sf, "documents").select("doc_id", "text", I.word(F.col("source")).alias("source"), F.xxhash64(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")).alias("cluster"))
    return scratch.cut(text_sizes(d, "text", ["doc_id", "source", "cluster"]), "sizes")


def _packed(spark: SparkSession, sf: str, scratch: Scratch) -> DataFrame:
    from tarn.llm.packing import pack

    return pack(_sized(spark, sf, scratch), _read(spark, sf, "pack_specs"), scratch)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "p6")
    return scratch.finish(_packed(spark, sf, scratch).where("pieces > 1 and piece = 0").select("spec", "doc_id"))


def p6_windows(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "p6")
    return scratch.finish(_packed(spark, sf, scratch))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    from tarn.llm.packing import pack_report

    scratch = Scratch(spark, "p6")
    return scratch.finish(pack_report(_packed(spark, sf, scratch), per_source=8))


def p6_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens and pieces of each spec's windows; windows over capacity; texts with a token left out or twice; windows with two copies of a text."""
    scratch = Scratch(spark, "p6")
    w = scratch.cut(_packed(spark, sf, scratch), "windows")
    copies = _read(spark, sf, "documents").select("doc_id", F.md5(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")).alias("copy"))
    per = w.groupBy("spec", "capacity", "window").agg(F.sum("tokens").alias("t"), F.count("*").alias("pieces"))
    total = per.groupBy("spec").agg(F.sum("t").cast("long").alias("tokens"), F.sum("pieces").cast("long").alias("pieces"), F.count_if(F.col("t") > F.col("capacity")).alias("over"))
    parts = w.groupBy("spec", "doc_id").agg(F.count("*").alias("k"), F.max("pieces").alias("n"), F.count_distinct("start").alias("s"), F.max(F.col("start") + F.col("tokens")).alias("end"), F.sum("tokens").alias("t"))
    gaps = parts.groupBy("spec").agg(F.count_if((F.col("k") != F.col("n")) | (F.col("s") != F.col("k")) | (F.col("end") != F.col("t"))).alias("gaps"))
    twins = w.select("spec", "window", "doc_id").distinct().join(copies, "doc_id").groupBy("spec", "window", "copy").agg(F.count("*").alias("k")).groupBy("spec").agg(F.count_if(F.col("k") > 1).alias("copies_together"))
    return scratch.finish(total.join(gaps, "spec").join(twins, "spec"))


# --- 7: mixes -------------------------------------------------------------------------------


def _planned(spark: SparkSession, sf: str, mode: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    from tarn.llm.mixing import plan_mixes

    docs = _sized(spark, sf, scratch).select("doc_id", "source", F.col("size").alias("tokens"))
    return docs, plan_mixes(docs.groupBy("source").agg(F.sum("tokens").alias("tokens")), _read(spark, sf, "mix_targets"), mode)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "p7")
    return scratch.finish(_planned(spark, sf, "given", scratch)[1].where("short > 0").select("mix_id", "source"))


def p7_selection(spark: SparkSession, sf: str) -> DataFrame:
    from tarn.llm.mixing import realise

    scratch = Scratch(spark, "p7")
    return scratch.finish(realise(*_planned(spark, sf, "given", scratch)))


def _mixed(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    from tarn.llm.mixing import mix_report, realise

    scratch = Scratch(spark, "p7")
    docs, planned = _planned(spark, sf, mode, scratch)
    return scratch.finish(mix_report(planned, realise(docs, planned)))


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf, "given")


def p7_temperature(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf, "temperature")


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Budget of each source of a mix, documents used more often than allowed, and whether the budget is reached to within half of the source's longest text."""
    from tarn.llm.mixing import realise

    scratch = Scratch(spark, "p7")
    docs, planned = _planned(spark, sf, "given", scratch)
    got = realise(docs, planned).groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used"), F.max("uses").alias("most"), F.collect_set("uses").alias("all"))
    longest = docs.groupBy("source").agg(F.max("tokens").alias("longest"))
    j = planned.drop("tokens").join(got, ["mix_id", "source"], "left").join(longest, "source", "left")
    ok = F.abs(F.coalesce("used", F.lit(0)) - F.col("budget")) <= F.coalesce("longest", F.lit(0)) / 2 + 1
    return scratch.finish(j.select("mix_id", "source", F.round("budget", 3).alias("budget"), (F.coalesce("most", F.lit(0)) > F.col("max_repeats")).cast("long").alias("too_often"), ok.alias("reached")))


# --- 8: text quality ------------------------------------------------------------------------


def p8_statistics(spark: SparkSession, sf: str) -> DataFrame:
    from tarn.llm.quality import fit_model, kind, text_statistics

    d = _read(spark, sf, "documents").select("doc_id", "text")
    return text_statistics(d, "doc_id", "text", fit_model(d, "text", Scratch(spark, "quality"))).withColumn("kind", kind())


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_statistics(spark, sf).where("kind is not null").select("doc_id", "kind")


def p8_counts(spark: SparkSession, sf: str) -> DataFrame:
    return p8_statistics(spark, sf).select("doc_id", "n_words")


_ALL = (
    p1_found, p1_labels, p2_found, p2_classes, p3_found, p3_consensus, p3_reliability, p3_agreement, p3_checks, p4_found, p4_assignment, p4_report, p4_checks, p5_found, p5_sample, p5_report, p5_shortfalls, p5_checks,
    p6_found, p6_windows, p6_report, p6_checks, p7_found, p7_selection, p7_report, p7_temperature, p7_checks, p8_found, p8_statistics, p8_counts,
)
QUERIES = {f.__name__: f for f in _ALL}
