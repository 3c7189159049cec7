"""Connected components by hash-to-min, on rows (node, member)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.storage import Scratch

#: Rounds after which the operator gives up; hash-to-min needs about log2 of the longest path.
MAX_ROUNDS = 60
#: A node whose cluster has more rows than this is joined by broadcast; there are at most rows / HOT_ROWS of them.
HOT_ROWS = 2_000_000


def _with_least(now: DataFrame, least: DataFrame, large: bool) -> DataFrame:
    """Rows (v, u, m) with the smallest member m of v's cluster. The smallest node of a component holds all of it: in ``large`` tables such nodes never meet their rows in one task."""
    if not large:
        return now.join(least.drop("n"), "v").select("v", "u", "m")
    hot = least.where(F.col("n") > HOT_ROWS).select("v", "m")
    held = now.join(F.broadcast(hot), "v").select("v", "u", "m")
    return now.join(F.broadcast(hot.select("v")), "v", "left_anti").join(least.drop("n"), "v").select("v", "u", "m").union(held)


def hash_to_min(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Component of every node of an edge table, as rows (node, component).

    Each node keeps a cluster of nodes, at first itself and its neighbours. In
    each round a node sends its cluster to the smallest member and the smallest
    member to its cluster; when nothing changes, the smallest node of each
    component holds the whole component and every other node only that
    smallest one. Clusters are rows, never arrays, so that a component of any
    size spreads over tasks; minima are aggregated before the shuffle.

    Edges with a null end and loops tie nothing: a null end is left out, a loop
    makes its node a component of its own. Repeated edges count once; an empty
    table gives an empty result. The component is named by its smallest node.
    """
    e = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null")
    rows = e.union(e.select("u", "v")).union(e.select("v", F.col("v").alias("u"))).union(e.select("u", F.col("u")).toDF("v", "u"))
    now = scratch.cut(rows.distinct(), "clusters")
    mark = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x")).alias("m")
    before = now.agg(mark).first().m
    for _ in range(MAX_ROUNDS):
        least = now.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        sent = _with_least(now, least, before.n > HOT_ROWS)
        both = sent.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("r"))
        new = scratch.cut(both.select("r.*").distinct(), "clusters")
        scratch.drop(now)
        after = new.agg(mark).first().m
        now = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
