"""Splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.components import hash_to_min
from tarn.storage import Scratch

#: A new group with at least this share of all items is placed by remaining room; at most 1 / LARGE_SHARE such groups exist.
LARGE_SHARE = 0.01
#: Weights of the others are brought nearer to the remaining room in at most so many rounds.
ROUNDS = 12
#: Shares count as reached within this distance.
NEAR = 0.002


def related_groups(items: DataFrame, id_col: str, docs: Column, scratch: Scratch) -> DataFrame:
    """Rows (id, group): items sharing a document, directly or through other items, have one group.

    ``docs`` is an array of plain document ids. Nulls in it, a null and an
    empty array tie nothing: such an item is a group of its own, named
    ``item:<id>``; other groups are named ``doc:<smallest document>``. Items
    with a null id are left out, repeated rows of an id unite their documents.
    The graph has documents as nodes and one edge from the smallest document of
    an item to each other one, so that a document of any number of items
    adds no pairs of items.
    """
    one = items.select(F.col(id_col).alias("id"), F.array_sort(F.array_compact(F.array_distinct(docs))).alias("docs")).where("id is not null")
    one = scratch.cut(one.select("id", F.coalesce("docs", F.array()).alias("docs")).distinct(), "items")
    node = F.get("docs", F.lit(0))
    edges = one.where(F.size("docs") > 0).select(node.alias("a"), F.explode("docs").alias("b"))
    # an id with several document lists ties these together
    several = one.groupBy("id").agg(F.count("*").alias("n"), F.min(node).alias("a")).where("n > 1 and a is not null").select("id", "a")
    more = one.where(F.size("docs") > 0).join(several, "id").select("a", node.alias("b"))
    comp = hash_to_min(edges.union(more), scratch)
    first = one.groupBy("id").agg(F.min(node).alias("node"))
    named = first.join(comp, "node", "left")
    return named.select("id", F.when(F.col("node").isNull(), F.concat(F.lit("item:"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("doc:"), F.col("component"))).alias("group"))


def torn_groups(grouped: DataFrame, split: str = "split") -> DataFrame:
    """Rows of ``grouped`` (id, group, split) whose group lies in more than one split; a null split is none."""
    torn = grouped.groupBy("group").agg(F.min(split).alias("lo"), F.max(split).alias("hi")).where("lo <> hi").select("group")
    return grouped.join(torn, "group", "left_semi")


def assign_splits(grouped: DataFrame, targets: DataFrame, seed: int = 17, kept: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A split for every group, by weighted rendezvous hashing; rows (id, group, new_split) and a report.

    ``targets`` has split_name and share (any positive numbers; they are
    normalised; null and non-positive shares get nothing). Each group goes to
    the split with the greatest ``-weight / ln(u)`` where u is a hash of group
    and split. Groups of at least LARGE_SHARE of all items would upset the shares if hashed: they are placed before,
    largest first, where most room is left. Weights of the others start from the remaining room and, as
    middle-sized groups upset them too, are multiplied by what each split lacks, until the room is filled within NEAR of the items
    or for ROUNDS rounds; the best are kept, and the report tells them.

    An assignment stays when groups come or go if the earlier one is passed on as ``kept`` (group, new_split): every group in it
    that goes to a split of ``targets`` keeps its place, whatever its size, and only new groups are placed in the room that is left.

    Ties go to the last split name. Without any positive share, or without items, the result is empty.
    The report has split_name, share, weight, rows and reached for every split.
    """
    spark = grouped.sparkSession
    wanted = {r.split_name: float(r.share) for r in targets.where("split_name is not null and share > 0").groupBy("split_name").agg(F.sum("share").alias("share")).collect()}
    total = sum(wanted.values())
    share = {k: v / total for k, v in sorted(wanted.items())}
    scratch = Scratch(spark, "splits")
    sizes = grouped.groupBy("group").agg(F.count("*").alias("n"))
    if kept is not None:
        old = kept.where(F.col("new_split").isin(*share)).groupBy("group").agg(F.min("new_split").alias("_old"))
        sizes = sizes.join(old, "group", "left")
    else:
        sizes = sizes.withColumn("_old", F.lit(None).cast("string"))
    sizes = scratch.cut(sizes, "sizes")
    n = (sizes.agg(F.sum("n")).first()[0] or 0) if wanted else 0
    if not n:
        none = "id string, `group` string, new_split string"
        return spark.createDataFrame([], none), spark.createDataFrame([], "split_name string, share double, weight double, rows long, reached double")
    room = {k: v * n for k, v in share.items()}
    for r in sizes.where("_old is not null").groupBy("_old").agg(F.sum("n").alias("n")).collect():  # a row for each split
        room[r["_old"]] -= r.n
    placed = {}
    for r in sizes.where(F.col("_old").isNull() & (F.col("n") >= LARGE_SHARE * n) & (F.col("n") > 1)).orderBy(F.desc("n"), "group").collect():
        placed[r.group] = k = max(room, key=lambda x: (room[x], x))
        room[k] -= r.n
    unit = lambda k: (F.pmod(F.xxhash64(F.col("group"), F.lit(k), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    def place(w: dict[str, float]) -> Column:
        return F.array_max(F.array(*[F.struct((-F.lit(w[k]) / F.log(unit(k))).alias("s"), F.lit(k).alias("k")) for k in w]))["k"]

    table = spark.createDataFrame(list(placed.items()), "`group` string, _large string")
    sizes = sizes.join(F.broadcast(table), "group", "left")  # at most 1 / LARGE_SHARE rows
    rest = sizes.where("_old is null and _large is null")
    want = {k: max(v, 0.0) for k, v in room.items()}
    weight = best = {k: max(v, 1e-9) for k, v in room.items()}
    off = float("inf")
    for _ in range(ROUNDS):
        got = {r.k: r.n for r in rest.groupBy(place(weight).alias("k")).agg(F.sum("n").alias("n")).collect()}  # a row for each split
        worst = max(abs(got.get(k, 0) - want[k]) for k in want) / n
        if worst < off:
            best, off = weight, worst
        if off <= NEAR or not got:
            break
        weight = {k: weight[k] * min(4.0, max(0.25, (want[k] + 1) / (got.get(k, 0) + 1))) ** 0.7 for k in want}
    where = sizes.select("group", F.coalesce("_old", "_large", place(best)).alias("new_split"))
    out = scratch.cut(grouped.select("id", "group").join(where, "group").select("id", "group", "new_split"), "assigned")
    got = out.groupBy(F.col("new_split").alias("split_name")).agg(F.count("*").alias("rows"))
    goal = spark.createDataFrame([(k, share[k], best[k] / sum(best.values())) for k in share], "split_name string, share double, weight double")
    report = goal.join(got, "split_name", "left").select("split_name", "share", "weight", F.coalesce("rows", F.lit(0)).alias("rows"), (F.coalesce("rows", F.lit(0)) / n).alias("reached"))
    return out, report
