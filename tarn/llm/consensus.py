"""Consensus from the labels of several annotators, by confidence-aware truth discovery."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm._items import half_width, trimmed
from tarn.storage import Scratch, shared_dir

#: Spellings of the two verdicts (fixed values); anything else is undecided and does not count.
PASS = ("pass", "passed", "通过", "合格")
FAIL = ("fail", "failed", "不通过", "不合格")

#: Labellers up to this many are joined by broadcast (about 50 bytes each), more by a shuffle; the result is the same.
BROADCAST_LABELLERS = 200_000
#: Votes of one item in a task; an item with more is dealt to several.
VOTES_A_TASK = 100_000


def verdict(c: Column) -> Column:
    """``pass`` or ``fail`` for any spelling of a decided verdict, else null."""
    t = F.regexp_replace(F.lower(trimmed(half_width(c))), r"[\s\p{P}]+", "")
    return F.when(t.isin(*PASS), F.lit("pass")).when(t.isin(*FAIL), F.lit("fail"))


def chi2_quantile(q: float, n: int) -> float:
    """The q quantile of chi-squared with n degrees of freedom, by bisection of the incomplete gamma function."""
    a = n / 2.0

    def cdf(x: float) -> float:
        x /= 2
        if x <= 0:
            return 0.0
        if x < a + 1:
            term = total = 1.0 / a
            k = a
            while term > total * 1e-14:
                k += 1
                term *= x / k
                total += term
            return total * math.exp(a * math.log(x) - x - math.lgamma(a))
        tiny = 1e-300
        b = x + 1 - a
        c, d = 1 / tiny, 1 / b
        h = d
        for i in range(1, 100_000):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b or tiny)
            c = b + an / c or tiny
            h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return 1 - h * math.exp(a * math.log(x) - x - math.lgamma(a))

    z = NormalDist().inv_cdf(q)
    if n > 1000:  # the expansion in powers of 1 / sqrt(n) is exact to nine digits there
        r = math.sqrt(2 * n)
        return n + z * r + 2 / 3 * (z**2 - 1) + (z**3 - 7 * z) / (9 * r) - (6 * z**4 + 14 * z**2 - 32) / (405 * n) + (9 * z**5 + 256 * z**3 - 433 * z) / (4860 * r * n)
    lo, hi = 0.0, max(4 * n * max(1e-6, 1 - 2 / (9 * n) + z * math.sqrt(2 / (9 * n))) ** 3, n + 20.0)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < q else (lo, mid)
    return (lo + hi) / 2


def holding_labels(labels: DataFrame, item: Sequence[str], labeller: str = "labeller", label: str = "label", at: str = "at") -> DataFrame:
    """One row for each item and labeller: the decided label with the latest time.

    Rows lacking an item key, a labeller or a decided label do not count. Equal
    times (repeats, or a contradiction at one time) are settled by the
    greatest label; a missing time is earlier than any other.
    """
    item = list(item)
    kept = labels.dropna(subset=[*item, labeller, label])
    return kept.groupBy(*item, labeller).agg(F.max(F.struct(F.col(at), F.col(label))).alias("_m")).select(*item, F.col(labeller).alias("labeller"), F.col("_m")[label].alias("label"))


def discover(votes: DataFrame, item: Sequence[str], scratch: Scratch, level: float = 0.05, max_rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """Consensus labels and labeller reliability, by alternating two steps until no label changes.

    ``votes`` has the item columns, labeller and label, one row for each
    labeller and item (``holding_labels``). Start: each item's most frequent
    label. Weights: a labeller's squared distance from the consensus (0 or 1
    for a label) is averaged within each consensus label and then over these,
    so that one who always gives the common label gains nothing by it; with n
    labels and mean distance d the error variance is at most
    u = n * d / chi2(level / 2, n) with confidence 1 - level / 2. The weight
    is the log of (1 - u) (k - 1) / u for k labels, and (almost) 0 for u of
    chance and more: it falls with the upper bound, a labeller with few labels
    is trusted less than one with as good a record over many, and one no
    better than guessing not at all. (The plain inverse of u lets one or two
    labellers outvote all others.) The
    distance is taken from what the others alone would decide (ties tell
    nothing): measured against a consensus that holds the own vote, the
    heaviest labeller confirms itself round after round until it alone
    decides. Labels: the one with the greatest total weight, which minimises
    the weighted distance. Ties go to the label with more labellers, then to
    the first in order (fail before pass).

    Returns (items, labellers): items with the item columns, label, labels,
    agreement (share of labellers with the consensus) and support (their share
    of the weight); labellers with labeller, labels, errors, accuracy,
    variance_bound, weight, and settled: false if labels still changed after
    ``max_rounds``, or came back to an earlier state in turns (the state with the fewest errors of a turn is
    then kept). Empty votes give empty tables. Votes are written once, partitioned by item, with what an item
    has beyond VOTES_A_TASK dealt to further parts; in a round only sums by item and one row for each labeller move.
    """
    spark = votes.sparkSession
    item = list(item)
    v = scratch.cut(votes.select(*item, "labeller", "label"), "votes")
    crowded = v.groupBy(*item).agg(F.count("*").alias("_k")).where(F.col("_k") > VOTES_A_TASK).select(*item, F.ceil(F.col("_k") / VOTES_A_TASK).cast("int").alias("_parts"))
    crowded = scratch.cut(crowded, "crowded")
    salted = not crowded.isEmpty()
    part = item
    if salted:
        part = [*item, "_part"]
        v = v.join(crowded, item, "left").withColumn("_part", F.pmod(F.xxhash64("labeller"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    # a checkpoint in the shared folder keeps the partitioning by item, which a written table would lose
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    stored = v.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *part).checkpoint()
    counts = stored.groupBy("labeller").agg(F.count("*").alias("n"))
    # degrees of freedom differ between labellers only by their count: one row for each count
    ns = [r.n for r in counts.select("n").distinct().collect()] if counts.limit(BROADCAST_LABELLERS + 1).count() <= BROADCAST_LABELLERS else None
    if ns is not None:
        chi = spark.createDataFrame([(n, float(chi2_quantile(level / 2, n))) for n in ns], "n long, chi double")
        base = F.broadcast(counts.join(F.broadcast(chi), "n"))
    else:
        udf = F.udf(lambda n: float(chi2_quantile(level / 2, n)), "double")
        base = counts.join(counts.select("n").distinct().withColumn("chi", udf("n")), "n")
    small = ns is not None
    hint = F.broadcast if small else (lambda x: x)
    kinds = max(2, stored.agg(F.count_distinct("label")).first()[0])
    chance = 1 - 1 / kinds

    def truth(weighted: DataFrame) -> DataFrame:
        """The winning label of each item with its weight and the next label's."""
        each = weighted.groupBy(*part, "label").agg(F.sum("_w").alias("_sw"), F.count("*").alias("_c"))
        if salted:
            each = each.groupBy(*item, "label").agg(F.sum("_sw").alias("_sw"), F.sum("_c").alias("_c"))
        # labels are few for an item; least of negatives: greatest weight, then count, then first label
        top = F.array_sort(F.collect_list(F.struct((-F.round("_sw", 9)).alias("w"), (-F.col("_c")).alias("c"), F.col("label").alias("label"))))
        t = each.groupBy(*item).agg(top.alias("_top"))
        if salted:  # one row for each part of an item
            t = t.join(F.broadcast(crowded), item, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
            return t.select(*part, F.get("_top", F.lit(0))["label"].alias("_truth"), "_top")
        return t.select(*item, F.get("_top", F.lit(0))["label"].alias("_truth"), "_top")

    def weigh(weighted: DataFrame) -> DataFrame:
        rows = weighted.join(truth(weighted), part)
        mine = F.element_at(F.filter("_top", lambda x: x["label"] == F.col("label")), 1)["w"]  # a negative
        other = F.coalesce(F.array_min(F.transform(F.filter("_top", lambda x: x["label"] != F.col("label")), lambda x: x["w"])), F.lit(0.0))
        rest = F.least(F.round(mine + F.col("_w"), 6), F.lit(0.0))  # the others' weight for the own label
        other = F.round(other, 6)
        rival = F.array_min(F.filter("_top", lambda x: x["label"] != F.col("label")))["label"]
        told = F.when(other < rest, rival).when(other > rest, F.col("label"))  # what the others decide
        e = rows.select("labeller", "label", told.alias("told")).groupBy("labeller", "told").agg(F.count("*").alias("n"), F.sum((F.col("label") != F.col("told")).cast("int")).alias("e"))
        known = F.col("told").isNotNull()
        d = F.sum(F.when(known, (F.col("e") + 0.5) / (F.col("n") + 1)).otherwise(0.0)) + (kinds - F.sum(known.cast("int"))) * chance
        e = e.groupBy("labeller").agg(F.sum(F.when(known, F.col("e")).otherwise(0)).alias("errors"), (d / kinds).alias("d"))
        w = e.join(base, "labeller").select("labeller", F.col("n").alias("labels"), "errors", (F.col("d") * F.col("n") / F.col("chi")).alias("variance_bound"))
        u = F.least("variance_bound", F.lit(chance))
        return w.withColumn("weight", F.greatest(F.log((1 - u) * (kinds - 1) / u), F.lit(1e-6)))

    def weighted() -> DataFrame:
        return stored.join(hint(w.select("labeller", F.col("weight").alias("_w"))), "labeller")

    keep = lambda x: scratch.cut(x.coalesce(1) if small else x, "weights")
    w = keep(weigh(stored.withColumn("_w", F.lit(1.0))))
    seen: dict[tuple, int] = {}
    states, settled = [w], False
    for _ in range(max_rounds):
        w = keep(weigh(weighted()))
        mark = tuple(w.agg(F.sum("errors"), F.bit_xor(F.xxhash64("labeller", "errors"))).first())
        settled = seen.get(mark) == len(states) - 1
        if mark in seen:
            turn = states[seen[mark] :] + [w]
            w = w if settled else min(turn[1:], key=lambda x: x.agg(F.sum("errors")).first()[0])
            break
        seen[mark] = len(states)
        states.append(w)
    joined = weighted()
    t = truth(joined).drop("_top")
    agree = F.col("label") == F.col("_truth")
    items = joined.join(t, part).groupBy(*item, "_truth").agg(F.count("*").alias("labels"), F.avg(agree.cast("double")).alias("agreement"), (F.sum(F.when(agree, F.col("_w")).otherwise(0.0)) / F.sum("_w")).alias("support"))
    items = scratch.cut(items.withColumnRenamed("_truth", "label"), "consensus")
    labellers = w.withColumn("accuracy", 1 - F.col("errors") / F.col("labels"))
    return items, labellers.select("labeller", "labels", "errors", "accuracy", "variance_bound", "weight", F.lit(settled).alias("settled"))


def agreement(votes: DataFrame, item: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Krippendorff's alpha for nominal labels: overall, or for each value of ``by``.

    Items with one label have no pair and do not count. alpha is null where no
    pairs exist or where only one label occurs. Columns: by, items, labels,
    observed (share of disagreeing pairs), expected, alpha.
    """
    item, by = list(item), list(by)
    per = votes.groupBy(*item, "label").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*item)
    per = per.withColumn("_m", F.sum("_c").over(w)).where("_m > 1")
    o = per.groupBy(*dict.fromkeys([*by, *item])).agg(F.max("_m").alias("_m"), F.sum(F.col("_c") * (F.col("_c") - 1)).alias("_same"))
    o = o.groupBy(*by).agg(F.count("*").alias("items"), F.sum("_m").alias("labels"), F.sum((F.col("_m") * (F.col("_m") - 1) - F.col("_same")) / (F.col("_m") - 1)).alias("_d"))
    e = per.groupBy(*by, "label").agg(F.sum("_c").alias("_c"))
    e = e.groupBy(*by).agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.col("_c")).alias("_sq"))
    both = o.join(e, by) if by else o.crossJoin(e)  # one row each
    out = both.withColumn("observed", F.col("_d") / F.col("_n")).withColumn("expected", F.try_divide(F.col("_n") * F.col("_n") - F.col("_sq"), F.col("_n") * (F.col("_n") - 1)))
    return out.select(*by, "items", "labels", "observed", "expected", (1 - F.try_divide("observed", F.col("expected"))).alias("alpha"))
