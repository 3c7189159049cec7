"""Mixing sources to target weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The documents of a source fall into this many blocks; only the block that a budget cuts is put in order.
BLOCKS = 4096


def entropy(p: list[float]) -> float:
    return -sum(x * math.log(x) for x in p if x > 0)


def tempered(share: list[float], exponent: float) -> list[float]:
    """Shares to a power, normalised; the greatest is taken as 1 first, so that no power underflows to nothing for all."""
    top = max(share)
    w = [(s / top) ** exponent if s > 0 else 0.0 for s in share]
    return [x / sum(w) for x in w]


def fit_exponent(share: list[float], target_entropy: float | None = None, room: list[float] | None = None) -> float:
    """The exponent in [0, 1] for shares, found by bisection.

    With ``target_entropy``: where the entropy of the tempered shares meets it (entropy falls
    as the exponent rises; a target out of reach gives the nearer end). With
    ``room`` (the largest weight each source can have within its repeats): the
    smallest exponent, the flattest mix, at which every weight has room; 1 if
    there is none. With both: the greater of the two.
    """
    if not share or max(share) <= 0:
        return 1.0

    def bisect(fine) -> float:
        if fine(0.0):
            return 0.0
        if not fine(1.0):
            return 1.0
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if fine(mid) else (mid, hi)
        return hi

    a = [0.0]
    if target_entropy is not None:
        a.append(bisect(lambda x: entropy(tempered(share, x)) <= target_entropy))
    if room is not None:
        a.append(bisect(lambda x: all(w <= r + 1e-12 for w, r in zip(tempered(share, x), room, strict=True))))
    return max(a)


def temper(share: list[float], target_entropy: float, room: list[float]) -> tuple[float, str]:
    """The exponent, from 0 to 64, whose mix comes nearest to the entropy within the room, and what it meets: both, repeats or entropy.

    Where no exponent fits the room, it is that of the entropy. Fits are sought in steps of 1/16 and then bisected.
    """
    if not share or max(share) <= 0:
        return 1.0, "none"
    off = lambda x: abs(entropy(tempered(share, x)) - target_entropy)
    fits = lambda x: all(w <= r + 1e-12 for w, r in zip(tempered(share, x), room, strict=True))
    lo, hi = 0.0, 1.0
    while hi < 64 and entropy(tempered(share, hi)) > target_entropy:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if entropy(tempered(share, mid)) <= target_entropy else (mid, hi)
    at, reached = hi, off(hi) < 1e-6
    if fits(at):
        return at, "both" if reached else "repeats"
    found = []
    for sign in (-1, 1):
        step = 1
        while 0 <= at + sign * (step - 1) / 16 <= 64:
            x = min(64.0, max(0.0, at + sign * step / 16))
            if fits(x):
                bad = at + sign * (step - 1) / 16
                for _ in range(60):
                    mid = (bad + x) / 2
                    bad, x = (bad, mid) if fits(mid) else (mid, x)
                found.append(x)
                break
            step += 1
    return (min(found, key=off), "repeats") if found else (at, "entropy" if reached else "none")


def dealt(weight: list[float], total: float, room: list[float]) -> list[float]:
    """Budgets within the room; what a source cannot hold goes to those with room left, by weight, until all is dealt or all are full."""
    out = [0.0] * len(weight)
    left = total
    while left > 1e-9 * max(1.0, total):
        free = [i for i, w in enumerate(weight) if w > 0 and room[i] - out[i] > 1e-9]
        if not free:
            break
        part = sum(weight[i] for i in free)
        give = {i: min(left * weight[i] / part, room[i] - out[i]) for i in free}
        for i, x in give.items():
            out[i] += x
        left -= sum(give.values())
    return out


def plan_mixes(sizes: DataFrame, targets: DataFrame, mode: str = "given") -> DataFrame:
    """Budget of tokens of each source of each mix.

    ``targets`` has mix_id, source, weight, max_repeats and total_tokens (a
    small table: one row for each source of a mix); ``sizes`` has source and
    tokens. A source can give at most max_repeats times its tokens. Two modes:

    ``given``: the weights are wanted as they are; each is the exponent 1 of
    itself, so the budget is weight * total_tokens, cut at the source's room. ``exponent``
    tells how far the weights would have to be flattened towards the sources'
    own room for the mix to be reached whole: it is the greatest exponent in [0, 1] of the given
    weights, found by bisection, that fits the repetition limit; null if none does.

    ``temperature``: the weights are the sources' own token shares to a
    power: the exponent is bisected until the entropy is that of the given
    weights, or as near as the repetition limit lets it come (``temper``); the budget is that
    weight * total_tokens, and what exceeds a source's room is dealt to sources with room.
    A last column ``met`` tells what the exponent meets: both, repeats, entropy or none.

    Null weights are 0, a null max_repeats is 1; a source without documents has
    size 0. Result: mix_id, source, weight (wanted), total_tokens, max_repeats,
    tokens (of the source), room, budget, exponent, short (wanted tokens
    beyond the room, at least 0).
    """
    t = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).cast("long").alias("max_repeats"), F.max(F.coalesce("total_tokens", F.lit(0))).cast("long").alias("total_tokens"))
    both = t.join(sizes.groupBy("source").agg(F.sum("tokens").cast("long").alias("tokens")), "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))
    schema = "mix_id string, source string, weight double, total_tokens long, max_repeats long, tokens long, room double, budget double, exponent double" + (", met string" if mode == "temperature" else "")

    def plan(pdf):
        pdf = pdf.sort_values("source").reset_index(drop=True)
        total = pdf.total_tokens.astype(float)
        pdf["room"] = (pdf.max_repeats * pdf.tokens).astype(float)
        room = [r / n if n else 0.0 for r, n in zip(pdf.room, total, strict=True)]
        weight = pdf.weight.tolist()
        if mode == "temperature":
            own = pdf.tokens.astype(float).tolist()
            given = [w / sum(weight) for w in weight] if sum(weight) > 0 else [0.0 for _ in weight]
            a, pdf["met"] = temper(own, entropy(given), room)
            weight = tempered(own, a) if sum(own) else given
            pdf["weight"] = weight
            pdf["exponent"] = a
        else:
            fits = lambda x: all(w <= r + 1e-12 for w, r in zip(tempered(weight, x), room, strict=True))
            a = None
            if sum(weight) > 0:
                if fits(1.0):
                    a = 1.0
                elif fits(0.0):
                    lo, hi = 0.0, 1.0
                    for _ in range(60):
                        mid = (lo + hi) / 2
                        lo, hi = (mid, hi) if fits(mid) else (lo, mid)
                    a = lo
            pdf["exponent"] = a
            pdf["exponent"] = pdf["exponent"].astype("float64")
        if mode == "temperature":
            pdf["budget"] = dealt(weight, float(total.max()), pdf.room.tolist())
        else:
            pdf["budget"] = [min(w * n, r) for w, n, r in zip(weight, total, pdf.room, strict=True)]
        return pdf[["mix_id", "source", "weight", "total_tokens", "max_repeats", "tokens", "room", "budget", "exponent", *(["met"] if mode == "temperature" else [])]]

    planned = both.groupBy("mix_id").applyInPandas(plan, schema)
    return planned.withColumn("short", F.greatest(F.lit(0.0), F.col("weight") * F.col("total_tokens") - F.col("room")))


def realise(docs: DataFrame, planned: DataFrame, seed: int = 29) -> DataFrame:
    """Documents of each mix with their number of uses: rows (mix_id, source, doc_id, tokens, uses).

    ``docs`` has doc_id (unique), source and tokens. A source's documents are in
    a random order for each mix (hash of mix, document and seed). The budget is spent in whole passes
    over the source and a last pass that ends with the first
    document that brings the source to its budget or nearest to it: that one is taken if this
    leaves the sum nearer. Whole passes need no order. For the last one, documents fall
    into blocks; block sums are few rows; blocks before the one where the
    budget ends are taken whole, and only that block is put in order, so that no
    task ever sorts a source. Documents without tokens are left out.
    """
    p = planned.where("budget > 0 and tokens > 0").withColumn("passes", F.floor(F.col("budget") / F.col("tokens")).cast("long"))
    p = p.withColumn("left", F.col("budget") - F.col("passes") * F.col("tokens"))
    d = docs.where("tokens > 0").select("doc_id", "source", F.col("tokens").alias("_t"))
    key = F.pmod(F.xxhash64("doc_id", "mix_id", F.lit(seed)), F.lit(1 << 52))
    rows = d.join(F.broadcast(p.select("mix_id", "source", "passes", "left")), "source").withColumn("_key", key).withColumn("_block", (F.col("_key") / float(1 << 52) * BLOCKS).cast("int"))
    w = Window.partitionBy("mix_id", "source").orderBy("_block")
    blocks = rows.groupBy("mix_id", "source", "left", "_block").agg(F.sum("_t").alias("_n")).withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
    kind = blocks.where(F.col("_before") < F.col("left")).select("mix_id", "source", "_block", "_before", (F.col("_before") + F.col("_n") <= F.col("left")).alias("_whole"))
    got = rows.join(F.broadcast(kind), ["mix_id", "source", "_block"], "left")  # at most BLOCKS rows for each source of a mix
    cut = got.where("not _whole")
    order = Window.partitionBy("mix_id", "source", "_block").orderBy("_key", "doc_id")
    upto = F.col("_before") + F.sum("_t").over(order)
    cut = cut.withColumn("_upto", upto).withColumn("_in", (F.col("_upto") <= F.col("left")) | ((F.col("_upto") - F.col("_t") < F.col("left")) & (F.col("_upto") - F.col("left") < F.col("left") - (F.col("_upto") - F.col("_t")))))
    whole = got.where("_whole is null or _whole").select("mix_id", "source", "doc_id", "_t", (F.col("passes") + F.when(F.col("_whole"), 1).otherwise(0)).alias("uses"))
    part = cut.select("mix_id", "source", "doc_id", "_t", (F.col("passes") + F.col("_in").cast("int")).alias("uses"))
    out = whole.union(part).where("uses > 0")
    return out.select("mix_id", "source", "doc_id", F.col("_t").alias("tokens"), F.col("uses").cast("long").alias("uses"))


def mix_report(planned: DataFrame, realised: DataFrame) -> DataFrame:
    """The plan with the tokens used and the share of total_tokens that each source reached."""
    got = realised.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used"), F.max("uses").alias("most_uses"), F.count("*").alias("documents"))
    out = planned.join(got, ["mix_id", "source"], "left").fillna(0, ["used", "most_uses", "documents"])
    return out.withColumn("reached", F.try_divide(F.col("used").cast("double"), F.col("total_tokens").cast("double")))
