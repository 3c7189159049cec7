"""Quality control of evaluation sets, label handling and the small samples drawn for people."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import hamming, han_ratio, leak_ratio, question_norm, simhash
from tarn.operators.order import positions
from tarn.storage import Scratch

#: Bounds of a question's checks (fixed values).
LENGTH = (8, 200)
HAN_LEAST = 0.25
LEAK_MOST = 0.7
NEAR_BITS = 3


def near_fingerprints(df: DataFrame, key: str, fp: str, bits: int = NEAR_BITS) -> DataFrame:
    """Pairs (a, b), a < b, whose 64-bit fingerprints differ in at most ``bits``: exact, by pairs of blocks.

    With two blocks more than ``bits``, two such fingerprints agree in at least two blocks whole; each pair of blocks
    is a join key of about 26 bits (for 3 bits), so that keys stay rare in large tables. Keys of one fingerprint are
    collapsed first: they come as one group, paired with its smallest key, not with each other.
    """
    one = df.groupBy(F.col(fp).alias("_f")).agg(F.min(key).alias("_k"))
    same = df.select(F.col(key).alias("b"), F.col(fp).alias("_f")).join(one, "_f").where(F.col("_k") < F.col("b")).select(F.col("_k").alias("a"), "b")
    n = bits + 2
    cuts = [64 * i // n for i in range(n + 1)]
    mask = lambda i: ((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = list(itertools.combinations(range(n), 2))
    rows = one.select("_k", "_f", F.posexplode(F.array(*[F.col("_f").bitwiseAND(F.lit(signed(mask(i) | mask(j)))) for i, j in pairs])).alias("_i", "_b"))
    x, y = rows.select(F.col("_k").alias("a"), F.col("_f").alias("fa"), "_i", "_b"), rows.select(F.col("_k").alias("b"), F.col("_f").alias("fb"), "_i", "_b")
    near = x.join(y, ["_i", "_b"]).where((F.col("a") < F.col("b")) & (hamming(F.col("fa"), F.col("fb")) <= bits)).select("a", "b").distinct()
    return near.unionByName(same)


def accepted_in_order(first: DataFrame, near: DataFrame, scratch: Scratch) -> DataFrame:
    """Greedy pass in order of ids: (fp, id) of the fingerprints that no accepted earlier one is near.

    ``first`` has one row (fp, id) for each fingerprint, ``near`` the pairs (a, b) of fingerprints in both directions.
    In each round, rows without an undecided earlier neighbour are accepted and their
    neighbours rejected: the result is that of a loop over the rows, in as many rounds as the longest chain needs.
    """
    x, y = first.select(F.col("fp").alias("a"), F.col("id").alias("ia")), first.select(F.col("fp").alias("b"), F.col("id").alias("ib"))
    edges = scratch.cut(near.join(x, "a").join(y, "b").where("ia < ib").select("a", "b"), "edges")
    out = first.join(edges.select(F.col("b").alias("fp")), "fp", "left_anti")
    new = out.select("fp")
    while not edges.isEmpty():
        # neighbours of the accepted fall, with all edges from and to them
        fallen = scratch.cut(edges.join(new.select(F.col("fp").alias("a")), "a", "left_semi").select(F.col("b").alias("fp")).distinct(), "fallen")
        gone = fallen.unionByName(new.select("fp"))
        rest = scratch.cut(edges.join(gone.toDF("a"), "a", "left_anti").join(fallen.toDF("b"), "b", "left_anti"), "edges")
        # all undecided rows have an edge to an earlier one; those that have none left are accepted
        waiting = edges.select(F.col("b").alias("fp")).distinct().join(fallen, "fp", "left_anti")
        new = scratch.cut(waiting.join(rest.select(F.col("b").alias("fp")), "fp", "left_anti"), "accepted")
        out = scratch.cut(out.unionByName(first.join(new, "fp", "left_semi")), "all-accepted")
        edges = rest
    return out


def question_checks(items: DataFrame, passage: Column | None = None) -> DataFrame:
    """(id, reason): the first check that a question fails, null if none; first come, first kept among repeats.

    In order: empty, length, share of Han characters and repeats of the exact plain form
    of an accepted earlier id, near repeats by fingerprint of an accepted earlier id, and share of its 5-grams in the passage.
    Only questions that pass all checks are accepted: what is near a rejected one may stay.
    Out-of-scope items need no Han characters and have no passage.
    """
    scratch = Scratch(items.sparkSession, "checks")
    q = F.trim(F.coalesce("question", F.lit("")))
    inside = F.coalesce(F.col("type"), F.lit("")) != "out_of_scope"
    r = items.select("id", "type", q.alias("q"), question_norm(q).alias("norm"), (passage if passage is not None else F.lit("")).alias("p"))
    basic = F.when(F.col("q") == "", "empty").when((F.length("q") < LENGTH[0]) | (F.length("q") > LENGTH[1]), "length").when(inside & (han_ratio(F.col("q")) < HAN_LEAST), "han_ratio")
    leak = F.coalesce(inside & (leak_ratio(F.col("q"), F.col("p")) > LEAK_MOST), F.lit(False))
    r = scratch.cut(r.select("id", "norm", basic.alias("_basic"), F.when(basic.isNull(), leak).alias("_leak")), "basic")
    good = r.where("_basic is null")
    prints = simhash(good.groupBy("norm").agg(F.min("id").alias("_k")), "norm", "norm").withColumnRenamed("fingerprint", "fp")
    good = scratch.cut(good.join(prints, "norm").select("id", "norm", "fp", "_leak"), "prints")
    # rows of one fingerprint fall with the first of them that does not leak, or behind it
    one = good.select("fp").distinct()
    near = near_fingerprints(one.withColumn("k", F.col("fp")), "k", "fp")
    near = scratch.cut(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near")
    first = scratch.cut(good.where("not _leak").groupBy("fp").agg(F.min("id").alias("id")), "first")
    kept = accepted_in_order(first, near, scratch)
    exact = good.join(kept.select("id"), "id", "left_semi").select("norm", F.col("id").alias("_same"))
    reach = kept.select("fp", "id").unionByName(near.join(kept.select(F.col("fp").alias("a"), "id"), "a").select(F.col("b").alias("fp"), "id"))
    least = reach.groupBy("fp").agg(F.min("id").alias("_near"))
    g = good.join(exact, "norm", "left").join(least, "fp", "left")
    late = F.when(F.col("_same") < F.col("id"), "duplicate_exact").when(F.col("_near") < F.col("id"), "duplicate_near").when(F.col("_leak"), "leak")
    return r.where("_basic is not null").select("id", F.col("_basic").alias("reason")).unionByName(g.select("id", late.alias("reason")))


def badcase_gates(rows: DataFrame, known: DataFrame, passage: Column, most: int | None = None) -> DataFrame:
    """(id, outcome) of failed cases that are to become items of a set.

    ``known`` (id, question) is the set. A row whose id it has is no new case: its outcome is ``regression``, and it is left out if its
    ``attribution`` (where ``rows`` has that column) says 无问题. Others get the first gate that holds against them: missing question, truth or claims, documents;
    exact repeat of a known question; near repeat by fingerprint; share of 5-grams in ``passage``; and, only
    with ``most``, more than so many accepted of a type in order of ids. Else they are ``accepted``.
    """
    ids = known.select("id").distinct().withColumn("_known", F.lit(True))
    j = rows.withColumn("_p", passage).join(ids, "id", "left")
    old = j.where("_known")
    if "attribution" in rows.columns:
        old = old.where("coalesce(attribution, '') <> '无问题'")
    new = j.where("_known is null").withColumn("_q", F.coalesce("question", F.lit("")))
    has = known.where("question <> ''").select(F.col("question").alias("_q")).distinct()
    norms = known.select(question_norm(F.coalesce("question", F.lit(""))).alias("_norm")).distinct().withColumn("_exact", F.lit(True))
    prints = simhash(has.select("_q").unionByName(new.select("_q")).distinct(), "_q", "_q")
    one = prints.select("fingerprint").distinct()
    near = near_fingerprints(one.withColumn("k", F.col("fingerprint")), "k", "fingerprint")
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    there = prints.join(has, "_q", "left_semi").select("fingerprint").distinct()
    reach = there.unionByName(near.join(there.toDF("a"), "a", "left_semi").select(F.col("b").alias("fingerprint"))).distinct()
    close = prints.join(reach, "fingerprint", "left_semi").select("_q", F.lit(True).alias("_near"))
    refuse = F.coalesce(F.col("expected_behavior") == "refuse", F.lit(False))
    few = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    reason = (
        F.when(F.trim("_q") == "", "missing_question")
        .when(~refuse & ((F.coalesce("ground_truth", F.lit("")) == "") | few("key_claims")), "missing_truth_or_claims")
        .when(~refuse & few("supporting_docs"), "missing_documents")
        .when(F.col("_exact"), "duplicate_exact")
        .when(F.col("_near"), "duplicate_near")
        .when(leak_ratio(F.col("_q"), F.col("_p")) > LEAK_MOST, "leakage")
        .otherwise("accepted")
    )
    got = new.withColumn("_norm", question_norm(F.col("_q"))).join(norms, "_norm", "left").join(close, "_q", "left").select("id", "type", reason.alias("outcome"))
    if most is not None:
        typed = got.where("outcome = 'accepted' and type is not null")
        # with a fixed bound, only as many rows of a type leave each task
        first = typed.withColumn("_r", F.row_number().over(Window.partitionBy("type").orderBy("id"))).where(F.col("_r") <= most)
        full = typed.join(first.select("id"), "id", "left_anti").select("id", F.lit(True).alias("_full"))
        got = got.join(full, "id", "left").withColumn("outcome", F.when(F.col("_full"), "quota_full").otherwise(F.col("outcome")))
    return got.select("id", "outcome").unionByName(old.select("id", F.lit("regression").alias("outcome")))


def dataset_problems(items: DataFrame, suite: str | None = None, types: tuple[str, ...] = ("factual", "multi_hop", "colloquial", "out_of_scope", "adversarial")) -> DataFrame:
    """One row (id, problem) for each rule that an item breaks."""
    quality = F.col("suite") == "quality"
    answers = F.col("expected_behavior") == "answer"
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = {
        "suite": F.lit(False) if suite is None else F.col("suite") != suite,
        "question_empty": blank("question"),
        "type_unknown": quality & ~F.coalesce(F.col("type").isin(*types), F.lit(False)),
        "split_unknown": quality & ~F.coalesce(F.col("split").isin("dev", "holdout"), F.lit(False)),
        "no_documents": quality & answers & (F.coalesce(F.size("supporting_docs"), F.lit(0)) <= 0),
        "no_truth_or_claims": quality & answers & (blank("ground_truth") | (F.coalesce(F.size("key_claims"), F.lit(0)) <= 0)),
        "scope_not_refused": quality & (F.col("type") == "out_of_scope") & (F.col("expected_behavior") != "refuse"),
        "split_not_all": ~quality & (F.coalesce("split", F.lit("")) != "all"),
        "injection_behaviour": ~quality & F.col("safety_type").isin("injection_query", "injection_doc") & (F.col("expected_behavior") != "ignore_injection"),
        "injection_marker": ~quality & F.col("safety_type").isin("injection_query", "injection_doc") & blank("injection_marker"),
        "not_refused": ~quality & F.col("safety_type").isin("harmful", "boundary") & (F.col("expected_behavior") != "refuse"),
    }
    named = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    per = items.select("id", F.explode(named).alias("problem"))
    repeated = items.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("id_repeated").alias("problem"))
    return per.unionByName(repeated)


def quota_problems(items: DataFrame, quota: DataFrame) -> DataFrame:
    """Types whose total, dev and holdout counts differ from ``quota`` (type, total, dev, holdout); types without items are left out."""
    n = items.groupBy("type").agg(F.count("*").alias("has_total"), F.count_if(F.col("split") == "dev").alias("has_dev"), F.count_if(F.col("split") == "holdout").alias("has_holdout"))
    return n.join(F.broadcast(quota), "type").where("has_total <> total or has_dev <> dev or has_holdout <> holdout")  # a row for each type


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the last in order (partial aggregation, no window)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union of two tables with the later row of each key (on a tie, the new one)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, F.col(order), F.col("_new")).drop("_new")


def pending(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items that are not done yet."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def first_per(df: DataFrame, by: str, quota: dict[str, int], order: list[str]) -> DataFrame:
    """The first rows of each group in order, as many as its quota; groups without one are left out.

    The greatest quota bounds the rank, so that only so many rows of a group leave each task.
    """
    n = F.element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col(by))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= max(quota.values())).where(F.col("_r") <= n).drop("_r")


def filled_quotas(df: DataFrame, quota: dict[str, tuple[int, int]], order: list[str], by: str = "type") -> DataFrame:
    """The first rows of each type, as many as its total; the first ``dev`` of these in the split dev, the others in holdout.

    ``quota`` is (total, dev) for each type. The column ``split`` is replaced.
    """
    take = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in quota.items() for x in (k, v[i])]), F.col(by))
    r = df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= max(v[0] for v in quota.values()))
    return r.where(F.col("_r") <= take(0)).withColumn("split", F.when(F.col("_r") <= take(1), "dev").otherwise("holdout")).drop("_r")


def united(first: DataFrame, later: DataFrame, key: str = "id") -> DataFrame:
    """Rows of two sets; where both have a key, that of the later set holds (``first`` with one row for each key)."""
    return first.join(later.select(key).distinct(), key, "left_anti").unionByName(later, allowMissingColumns=True)


def failures_first(df: DataFrame, failed: Column, n: int, passes: int, order: list[str]) -> DataFrame:
    """A sample for people: failed rows up to n less the passes, then the first ``passes`` that passed (fewer if there are not as many)."""
    f = df.withColumn("_f", failed)
    good = f.where(~F.col("_f")).orderBy(*order).limit(passes)  # a bounded sort: each task keeps its first rows
    have = good.count()
    return f.where("_f").orderBy(*order).limit(max(0, n - have)).unionByName(good).drop("_f")


def controls(df: DataFrame, failed: Column, quota: dict[str, int], total: int, by: str, order: list[str]) -> DataFrame:
    """All failed rows, and ``total`` passed ones: a quota for each type first, topped up with the others in order."""
    f = df.withColumn("_f", failed)
    n = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col(by)), F.lit(0))
    # a group's rows behind its quota and the total can never be taken
    p = f.where(~F.col("_f")).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= max([*quota.values(), 0]) + total)
    p = p.withColumn("_in", F.col("_r") <= n).orderBy(F.desc("_in"), *order).limit(total)
    return f.where("_f").drop("_f").unionByName(p.drop("_f", "_r", "_in"))


def round_robin(df: DataFrame, buckets: int, by: str, key: str) -> DataFrame:
    """Balanced buckets over types: types by falling size, ids ascending, the buckets in turn; a row's place among all comes from counted ranges."""
    sizes = df.groupBy(by).agg(F.count("*").alias("_n"))
    with_size = df.join(F.broadcast(sizes), by)  # a row for each type
    placed = positions(with_size, [F.desc("_n"), F.col(by), F.col(key)], "_place", Scratch(df.sparkSession, "round-robin"))
    return placed.withColumn("bucket", (F.col("_place") % buckets).cast("int")).drop("_n", "_place")


def parity(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How far two tables agree row by row: rows of either, in both, and equal."""
    j = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_x")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_y")), keys, "full_outer")
    return j.agg(F.count("_x").alias("left_rows"), F.count("_y").alias("right_rows"), F.count_if(F.col("_x").isNotNull() & F.col("_y").isNotNull()).alias("both"), F.count_if(F.col("_a").eqNullSafe(F.col("_b")) & F.col("_x").isNotNull() & F.col("_y").isNotNull()).alias("same"))


def best_passage(questions: DataFrame, passages: DataFrame, by: str = "doc_id", n: int = 5) -> DataFrame:
    """For each question the passage of its document with the greatest share of its n-grams (3 digits; the first on ties)."""
    j = questions.select("id", by, "question").join(passages.select(by, "ord", "text"), by)
    s = j.withColumn("score", F.round(leak_ratio(F.col("question"), F.col("text"), n), 3))
    return s.groupBy("id").agg(F.max_by(F.struct("score", "ord"), F.struct(F.col("score"), -F.col("ord"))).alias("r")).select("id", "r.score", "r.ord")


def prefix_match(excerpts: DataFrame, texts: DataFrame, n: int = 120) -> DataFrame:
    """Texts that begin with the first n characters of an excerpt: one equi-join on the prefixes of those lengths that occur, first text in order wins."""
    e = excerpts.select("id", F.substring("excerpt", 1, n).alias("_k")).where("_k <> ''")
    lengths = sorted(r[0] for r in e.select(F.length("_k")).distinct().collect())  # at most n
    if not lengths:
        return e.select("id", F.lit(None).cast(texts.schema["text_id"].dataType).alias("text_id")).limit(0)
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda m: m <= F.length("_t")), lambda m: F.substring(F.col("_t"), F.lit(1), m))
    t = texts.select("text_id", F.substring("text", 1, n).alias("_t")).select("text_id", F.explode(prefixes).alias("_k"))
    return e.join(t, "_k").groupBy("id").agg(F.min("text_id").alias("text_id"))


def fresh_pages(pages: DataFrame, seen: DataFrame | None = None, least_han: int = 150, order: str = "url") -> DataFrame:
    """Crawled pages (url, text) with enough Han characters whose content is new: the first of each content, none of ``seen`` (sha256)."""
    p = pages.where(F.regexp_count("text", F.lit(r"[\x{4e00}-\x{9fff}]")) >= least_han).withColumn("sha256", F.sha2("text", 256))
    one = p.groupBy("sha256").agg(F.min_by(F.struct(*pages.columns), order).alias("_r")).select("_r.*", "sha256")
    return one.join(seen.select("sha256"), "sha256", "left_anti") if seen is not None else one


def passed_reviews(*rounds: DataFrame) -> DataFrame:
    """Ids that people passed in any round (id, decision)."""
    out = rounds[0].select("id", "decision")
    for r in rounds[1:]:
        out = out.unionByName(r.select("id", "decision"))
    return out.where("decision = 'pass'").select("id").distinct()


def merge_candidates(old: DataFrame, new: DataFrame, by: str = "type") -> DataFrame:
    """Candidates with the types of ``new`` replaced; new rows are numbered on after the greatest qid that stays."""
    keep = old.join(new.select(by).distinct(), by, "left_anti")
    top = keep.agg(F.coalesce(F.max("qid"), F.lit(0))).first()[0]
    fresh = positions(new, [by, "question"], "_place", Scratch(old.sparkSession, "candidates")).withColumn("qid", (F.lit(top) + F.col("_place") + 1).cast("long"))
    return keep.unionByName(fresh.select(*keep.columns))


def related_pairs(passages: DataFrame, n: int, tries: int = 10, seed: int = 3) -> DataFrame:
    """The n most alike pairs of passages of different documents among a random sample of pairs.

    ``passages`` has text_id, doc_id and text. At least 60 and ``tries`` * n pairs are tried: two
    rankings by hash, joined place by place, so that no cross join is formed.
    """
    k = max(60, tries * n)
    side = lambda s, x: passages.orderBy(F.xxhash64("text_id", F.lit(s)), "text_id").limit(k).withColumn("_p", F.row_number().over(Window.orderBy(F.xxhash64("text_id", F.lit(s)), "text_id"))).select("_p", F.col("text_id").alias(f"{x}_id"), F.col("doc_id").alias(f"_{x}"), F.col("text").alias(f"_t{x}"))
    from tarn.functions.text import jaccard

    j = side(seed, "a").join(side(seed + 1, "b"), "_p").where("_a <> _b")
    return j.select("a_id", "b_id", F.round(jaccard(F.col("_ta"), F.col("_tb")), 6).alias("jaccard")).orderBy(F.desc("jaccard"), "a_id", "b_id").limit(n)


def overlap(a: Column, b: Column) -> Column:
    """Share of two lists' union that both have, 1 if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(F.lit(1.0))


def order_match(a: Column, b: Column) -> Column:
    """Share of places at which two lists agree, of the longer list; 1 if both are empty."""
    n = F.greatest(F.size(a), F.size(b))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull()), lambda x: x))
    return F.when(n > 0, same / n).otherwise(F.lit(1.0))


def split_fragments(children: DataFrame, fragments: DataFrame) -> DataFrame:
    """Self-check of a test corpus: fragments (doc_id, fragment) that no child holds whole are found; each document's fragments must lie in different children.

    Rows (doc_id, fragments, children, ok).
    """
    j = fragments.join(children.select("doc_id", "chunk_uid", "text"), "doc_id", "left").where(F.contains("text", F.col("fragment")))
    first = j.groupBy("doc_id", "fragment").agg(F.min("chunk_uid").alias("chunk_uid"))
    n = fragments.groupBy("doc_id").agg(F.count_distinct("fragment").alias("fragments"))
    c = first.groupBy("doc_id").agg(F.count("*").alias("_found"), F.count_distinct("chunk_uid").alias("children"))
    return n.join(c, "doc_id", "left").select("doc_id", "fragments", F.coalesce("children", F.lit(0)).alias("children"), ((F.coalesce("_found", F.lit(0)) == F.col("fragments")) & (F.coalesce("children", F.lit(0)) == F.col("fragments"))).alias("ok"))
