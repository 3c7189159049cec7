"""Filling windows of fixed capacity with whole texts."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm._text import sizes
from tarn.session import ship
from tarn.storage import Scratch

#: Pieces that one task packs; more pieces make more tasks, never a larger one.
PIECES_A_TASK = 20_000


def text_sizes(df: DataFrame, text: str, keep: list[str], out: str = "size") -> DataFrame:
    """``keep`` columns with the size of the whole text in tokens of the BERT basic tokenizer; null texts have size 0."""
    ship(df.sparkSession)
    rows = df.select(*keep, F.col(text).alias("_text"))
    schema = rows.select(*keep, F.lit(0).cast("long").alias(out)).schema

    def run(batches):
        for pdf in batches:
            n = sizes(pdf.pop("_text").tolist())
            yield pdf.assign(**{out: n})[schema.names]

    return rows.mapInPandas(run, schema)


class _Bins:
    """Open bins in order of (residual, number), each with bitmaps of its sources and duplicate clusters."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int, per_source: int) -> int:
        """The tightest bin with room whose bitmaps allow the item; a new bin if there is none."""
        order = self.order
        i = bisect_left(order, (size, -1))
        while i < len(order):
            left, b = order[i]
            if not self.clusters[b] & cluster and self._count(b, source) < per_source:
                del order[i]
                break
            i += 1
        else:
            b, left = len(self.sources), self.capacity
            self.sources.append(0)
            self.clusters.append(0)
        self.clusters[b] |= cluster
        self._add(b, source)
        if left > size:
            at = (left - size, b)
            order.insert(bisect_left(order, at), at)
        return b

    # a source's count in a bin is kept in unary, as many bits as the limit, at the source's place
    def _count(self, b: int, source: tuple[int, int]) -> int:
        shift, width = source
        return (self.sources[b] >> shift & ((1 << width) - 1)).bit_count()

    def _add(self, b: int, source: tuple[int, int]) -> None:
        shift, width = source
        n = self._count(b, source)
        if n < width:
            self.sources[b] |= 1 << (shift + n)


def pack_pieces(size: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int, per_source: int) -> np.ndarray:
    """Bin number of each piece, best fit in order of falling size.

    Clusters that occur once get no bit; a bitmap holds a bit for each cluster
    with copies. A piece of a text that fills its bin alone never conflicts.
    """
    order = np.lexsort((np.arange(len(size)), -size))
    code, n = np.unique(cluster, return_inverse=True)
    many = np.bincount(n, minlength=len(code)) > 1
    bit = np.cumsum(many) - 1
    src = pd.factorize(source)[0]
    bins, out = _Bins(capacity), np.zeros(len(size), dtype=np.int64)
    for i in order.tolist():
        c = 1 << int(bit[n[i]]) if many[n[i]] else 0
        out[i] = bins.place(int(size[i]), (int(src[i]) * per_source, per_source), c, per_source)
    return out


def pack(items: DataFrame, specs: DataFrame, scratch: Scratch, id_col: str = "doc_id", size: str = "size", source: str = "source", cluster: str = "cluster", per_source: int = 8, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """Windows of each spec filled with whole items; rows (spec, capacity, window, doc_id, source, piece, pieces, start, tokens).

    An item larger than the capacity is divided into pieces of the capacity and
    a rest; no other item is divided. Two items of one duplicate cluster never
    share a window, nor do more than ``per_source`` of one source (bitmaps of
    each window). Items of size 0 take no room and are left out; so are null
    ids and specs without a positive capacity. Null sources and clusters
    conflict with nothing but, for sources, each other.

    Pieces are dealt at random to tasks of about ``pieces_a_task`` pieces, by
    a hash of the id: every task has the mix of sizes, and loses at most about one
    window. Only ids and sizes move, no texts.
    """
    ship(items.sparkSession)
    rows = items.select(F.col(id_col).alias("_id"), F.col(size).cast("long").alias("_size"), F.col(source).cast("string").alias("_source"), F.coalesce(F.col(cluster).cast("long"), F.xxhash64(F.col(id_col))).alias("_cluster")).where("_id is not null and _size > 0")
    s = specs.select("spec", F.col("capacity").cast("long").alias("capacity")).where("spec is not null and capacity > 0").groupBy("spec").agg(F.max("capacity").alias("capacity"))
    each = rows.crossJoin(F.broadcast(s))  # specs are few rows by nature
    last = F.floor((F.col("_size") - 1) / F.col("capacity")).cast("int")
    each = each.withColumn("_last", last).withColumn("piece", F.explode(F.sequence(F.lit(0), "_last")))
    each = each.withColumn("start", F.col("piece") * F.col("capacity")).withColumn("tokens", F.least("capacity", F.col("_size") - F.col("start")))
    pieces = scratch.cut(each.select("spec", "capacity", "_id", "_source", "_cluster", "piece", (F.col("_last") + 1).alias("pieces"), "start", "tokens"), "pieces")
    total = pieces.groupBy("spec").agg(F.count("*").alias("n")).select("spec", F.ceil(F.col("n") / pieces_a_task).cast("int").alias("tasks"))
    # copies of a text must come to one task for the bitmap to keep them apart, so the cluster decides; a large cluster is dealt round
    size_of = pieces.groupBy("spec", "_cluster").agg(F.count("*").alias("k")).where("k > 1")
    p = pieces.join(size_of, ["spec", "_cluster"], "left").join(F.broadcast(total), "spec")
    h = F.when(F.coalesce("k", F.lit(1)) > 64, F.xxhash64("_id", "piece")).otherwise(F.xxhash64("_cluster"))
    p = p.withColumn("_task", F.pmod(h, F.col("tasks")).cast("int")).drop("k", "tasks")
    id_type = dict(p.dtypes)["_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = pack_pieces(pdf["tokens"].to_numpy(), pdf["_source"].fillna("").to_numpy(), pdf["_cluster"].to_numpy(), int(pdf["capacity"].iloc[0]), per_source)
        task = int(pdf["_task"].iloc[0])
        return pdf.assign(window=[f"{task:06d}-{x:07d}" for x in b])[["spec", "capacity", "window", "_id", "_source", "piece", "pieces", "start", "tokens"]].rename(columns={"_source": "source"})

    out = p.groupBy("spec", "_task").applyInPandas(run, f"spec string, capacity long, window string, _id {id_type}, source string, piece int, pieces int, start long, tokens long")
    return out.withColumnRenamed("_id", id_col)


def pack_report(packed: DataFrame, per_source: int | None = None) -> DataFrame:
    """Windows, pieces, tokens, the share of room used, and the fewest windows that could hold the tokens, for each spec.

    With ``per_source`` (that of ``pack``) and a column ``source``, ``closed`` counts windows with room that hold
    as many texts of one source as they may: what that limit costs at most.
    """
    limited = per_source is not None and "source" in packed.columns
    by = ["spec", "capacity", "window"]
    if limited:
        s = packed.groupBy(*by, "source").agg(F.count("*").alias("_c"), F.sum("tokens").alias("_t"))
        w = s.groupBy(*by).agg(F.sum("_c").alias("pieces"), F.sum("_t").alias("tokens"), F.max("_c").alias("_most"))
    else:
        w = packed.groupBy(*by).agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.lit(0).alias("_most"))
    out = w.groupBy("spec", "capacity").agg(F.count("*").alias("windows"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.count_if((F.col("_most") >= (per_source or 0)) & (F.col("tokens") < F.col("capacity"))).alias("closed"))
    out = out.withColumns({"used": F.col("tokens") / (F.col("windows") * F.col("capacity")), "fewest_windows": F.ceil(F.col("tokens") / F.col("capacity"))})
    return out if limited else out.drop("closed")
