"""Samples that match target category proportions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The random keys of a category fall into this many bins; only the bin with the last key is sorted.
BINS = 4096


def quotas(available: DataFrame, plan: DataFrame, keys: Sequence[str], plan_id: str = "plan_id") -> DataFrame:
    """Integer quotas of each category of each plan, by largest remainder with floors and caps.

    ``plan`` has plan_id, the key columns, share, min_rows and sample_rows;
    ``available`` has the key columns and rows. A category gets at least its
    minimum and at most what is there; what is left of sample_rows is dealt by
    share among categories that have room, whole numbers first, then by the
    largest remainder (ties: in the order of the keys), again and again until
    all is dealt or no room is left. Null shares and minima count as 0, a
    category lacking in ``available`` has 0 rows; repeated rows of a plan's
    category add their shares. A plan whose minima exceed sample_rows keeps its
    minima.

    Result: plan_id, keys, share, min_rows, sample_rows, available, needed (the
    larger of share * sample_rows and min_rows), quota, shortfall (needed less
    available, at least 0). Plans are few rows by nature: a plan is one group
    here, rows of data never are.
    """
    keys = list(keys)
    p = plan.groupBy(plan_id, *keys).agg(
        F.sum(F.coalesce("share", F.lit(0.0))).alias("share"), F.max(F.coalesce("min_rows", F.lit(0))).cast("long").alias("min_rows"), F.max(F.coalesce("sample_rows", F.lit(0))).cast("long").alias("sample_rows")
    )
    have = available.select(*keys, F.col("rows").cast("long").alias("available"))
    both = p.join(have, keys, "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long")))

    def deal(pdf):
        import math

        pdf = pdf.sort_values(keys, kind="stable").reset_index(drop=True)
        cap = pdf.available.tolist()
        q = [min(c, m) for c, m in zip(cap, pdf.min_rows, strict=True)]
        want = [s * n for s, n in zip(pdf.share, pdf.sample_rows, strict=True)]
        left = int(pdf.sample_rows.max()) - sum(q)
        while left > 0:
            open_ = [i for i in range(len(q)) if q[i] < cap[i] and want[i] > 0]
            need = {i: max(0.0, want[i] - q[i]) for i in open_}
            weight = need if sum(need.values()) > 1e-9 else {i: want[i] for i in open_}
            total = sum(weight.values())
            if total <= 0:
                break
            part = {i: min(left * w / total, cap[i] - q[i]) for i, w in weight.items()}
            whole = {i: math.floor(x + 1e-9) for i, x in part.items()}
            if not any(whole.values()):
                for i in sorted(part, key=lambda i: (-(part[i] - whole[i]), i)):
                    if left == 0 or part[i] <= 0:
                        break
                    q[i] += 1
                    left -= 1
                continue
            for i, w in whole.items():
                q[i] += w
                left -= w
        pdf["needed"] = [max(w, float(m)) for w, m in zip(want, pdf.min_rows, strict=True)]
        pdf["quota"] = q
        return pdf

    schema = both.select(plan_id, *keys, "share", "min_rows", "sample_rows", "available", F.lit(0.0).alias("needed"), F.lit(0).cast("long").alias("quota")).schema
    out = both.groupBy(plan_id).applyInPandas(lambda pdf: deal(pdf)[schema.names], schema)
    return out.withColumn("shortfall", F.greatest(F.lit(0.0), F.col("needed") - F.col("available")))


def draw(items: DataFrame, id_col: str, keys: Sequence[str], dealt: DataFrame, plan_id: str = "plan_id", seed: int = 23) -> DataFrame:
    """For each plan, the ``quota`` items of each category with the smallest random keys.

    ``items`` has one row for each id; the random key is a hash of the id, so that the
    draw is the same on every run and a larger sample holds the smaller one. A category may
    hold any share of all rows: keys are counted in bins first, whole bins are
    taken by their count, and only rows of the bin that the quota cuts are
    ranked. Items with a null in a key column belong to no category.
    """
    keys = list(keys)
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    rows = items.dropna(subset=[id_col, *keys]).select(F.col(id_col).alias("_id"), *keys, F.pmod(h, F.lit(1 << 52)).alias("_key"))
    rows = rows.withColumn("_bin", (F.col("_key") / float(1 << 52) * BINS).cast("int"))
    w = Window.partitionBy(*keys).orderBy("_bin")
    bins = rows.groupBy(*keys, "_bin").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(w))
    quota = dealt.where("quota > 0").select(plan_id, *keys, "quota")
    cuts = bins.join(quota, keys).where(F.col("_upto") - F.col("_n") < F.col("quota"))
    cuts = cuts.select(plan_id, *keys, "_bin", (F.col("quota") - (F.col("_upto") - F.col("_n"))).alias("_left"), (F.col("_upto") > F.col("quota")).alias("_cut"))
    got = rows.join(cuts, [*keys, "_bin"])
    whole = got.where("not _cut").select(plan_id, *keys, "_id")
    r = F.row_number().over(Window.partitionBy(plan_id, *keys, "_bin").orderBy("_key", "_id"))
    part = got.where("_cut").withColumn("_r", r).where("_r <= _left").select(plan_id, *keys, "_id")
    return whole.union(part).withColumnRenamed("_id", id_col)


def report(dealt: DataFrame, drawn: DataFrame, keys: Sequence[str], plan_id: str = "plan_id") -> DataFrame:
    """``dealt`` with the rows drawn and the share they reached of each plan's sample."""
    keys = list(keys)
    n = drawn.groupBy(plan_id, *keys).agg(F.count("*").alias("drawn"))
    out = dealt.join(n, [plan_id, *keys], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long")))
    total: Column = F.sum("drawn").over(Window.partitionBy(plan_id))
    return out.withColumn("reached_share", F.when(total > 0, F.col("drawn") / total).otherwise(F.lit(0.0)))
