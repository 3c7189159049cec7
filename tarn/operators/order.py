"""Places and running sums over a whole table in order, without ever sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.storage import Scratch


def _ranges(df: DataFrame, order: Sequence[Column | str], scratch: Scratch) -> DataFrame:
    """``df`` cut with its range of the order as ``_p``: written once, so that counts and rows see the same ranges."""
    return scratch.cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")


def positions(df: DataFrame, order: Sequence[Column | str], name: str, scratch: Scratch) -> DataFrame:
    """``df`` with each row's place in order, from 0, as ``name``.

    Rows are counted by range; a range, never the table, is put in order in a task. Ties in
    ``order`` take places in any order.
    """
    r = _ranges(df, order, scratch)
    sizes = r.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    at = r.join(F.broadcast(sizes.select("_p", before.alias("_before"))), "_p")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return at.withColumn(name, (F.col("_before") + place - 1).cast("long")).drop("_p", "_before")


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """``df`` with sums over all rows up to and with each, in order within ``by``; ``sums`` names them.

    Sums are taken by range first; only the part of a group that lies in one range is put in order in a
    task. The row itself can be taken off again for the sum before it.
    """
    named = df.withColumns({f"_s{i}": c for i, c in enumerate(sums.values())})
    r = _ranges(named, [*by, *order], scratch)
    part = r.groupBy("_p", *by).agg(*[F.sum(f"_s{i}").alias(f"_t{i}") for i in range(len(sums))])
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range and group
    part = part.select("_p", *[F.col(b).alias(f"_by{j}") for j, b in enumerate(by)], *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    w = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = r.withColumns({f"_w{i}": F.sum(f"_s{i}").over(w) for i in range(len(sums))})
    on = within["_p"] == part["_p"]
    for j, b in enumerate(by):
        on = on & within[b].eqNullSafe(part[f"_by{j}"])
    out = within.join(part, on)
    return out.select(*[within[c] for c in df.columns], *[(F.coalesce(F.col(f"_w{i}"), F.lit(0)) + F.col(f"_b{i}")).alias(n) for i, n in enumerate(sums)])
