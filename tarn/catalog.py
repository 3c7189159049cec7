"""Queries over the reference operators, each over its whole tables; the same results in SQL are in ``tarn.oracles``."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.functions import spelling as P
from tarn.functions import stats as S
from tarn.functions import text as X
from tarn.operators import citations as C
from tarn.operators import curation as Q
from tarn.operators import evaluation as E
from tarn.operators import retrieval as R
from tarn.operators.order import running_sums
from tarn.oracles import ORACLE  # noqa: F401
from tarn.session import settle
from tarn.storage import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Contexts that an answer of the spot check had; the table does not say.
CONTEXTS = 4


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query; whole numbers come out as BIGINT, as the SQL beside it has them."""

    @wraps(f)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        settle(spark)
        df = f(spark, sf)
        return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if t == "int" else F.col(f"`{c}`") for c, t in df.dtypes])

    QUERIES[f.__name__] = run
    return run


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _long(c: Column) -> Column:
    return c.cast("long")


def _digest(a: Column) -> Column:
    return F.md5(F.array_join(a, "\x1f"))


def _spelt(df: DataFrame) -> DataFrame:
    """Categories in their plain spelling."""
    plain = {"type": P.word(F.col("type"), P.TYPE_NAMES), "split": P.split_name(F.col("split")), "suite": P.word(F.col("suite"))}
    return df.withColumns(plain | ({"difficulty": P.word(F.col("difficulty"), P.DIFFICULTY_NAMES)} if "difficulty" in df.columns else {}))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return _spelt(Q.latest(_t(spark, sf, "business_v1").drop("authoring"), ["id"], F.col("loaded_at")))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return _spelt(Q.latest(_t(spark, sf, "results"), ["trace_id"], F.col("loaded_at")))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return Q.latest(_t(spark, sf, "spotcheck_20261013_003"), ["case_id"], F.col("exported_at"))


def _verdict(c: Column) -> Column:
    v = F.regexp_replace(F.lower(c), r"[\s。]+", "")
    return F.when(v.isin("pass", "passed", "通过", "合格"), "pass").when(v.isin("fail", "failed", "不通过", "不合格"), "fail")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    """The label that holds of each annotator on each item, with the judge's verdict beside it."""
    c = _t(spark, sf, "calibration").select("id", "criterion", "segment", "annotator", _verdict(F.col("human.label")).alias("label"), _verdict(F.col("judge.verdict")).alias("judge"), _verdict(F.col("judge2.verdict")).alias("judge2"), F.col("code.pass").alias("code_pass"), "labelled_at")
    at = [F.col("labelled_at"), F.coalesce("label", F.lit("")), F.coalesce("judge", F.lit("")), F.coalesce("judge2", F.lit("")), F.coalesce("segment", F.lit("")), F.coalesce("code_pass", F.lit(True))]
    return Q.latest(c, ["id", "criterion", "annotator"], *at)


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """A stated query set: items whose number is divisible by 50."""
    i = _items(spark, sf).select(F.col("id").alias("qid"), F.col("question").alias("text"))
    return i.where(F.regexp_extract("qid", r"(\d+)$", 1).cast("long") % 50 == 0)


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.coalesce("text", F.lit("")).alias("text"), "origin_id")


# --- retrieval ------------------------------------------------------------------------------


@query
def rt_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: keyword and vector search over all documents, fused by reciprocal rank."""
    q, d = _questions(spark, sf), _corpus(spark, sf)
    v = R.nearest(R.histogram(q, "qid", "text"), d, 24, of=R.histogram_of)
    return R.fuse(v, R.bm25(q, d, 24)).select("qid", _long(F.col("row_id")).alias("doc_id"), "rrf_score", "vector_rank", "bm25_rank", "rank")


@query
def rt_bm25(spark: SparkSession, sf: str) -> DataFrame:
    h = R.bm25(_questions(spark, sf), _corpus(spark, sf), 24)
    return h.select("qid", F.col("row_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query
def rt_knn(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    q = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), "embedding")
    h = R.nearest(q, e.select(F.col("vec_id").alias("row_id"), "embedding"), 24)
    return h.select("qid", F.col("row_id").alias("vec_id"), F.round("score", 6).alias("distance"), "rank")


@query
def rt_histogram(spark: SparkSession, sf: str) -> DataFrame:
    h = R.histogram(_corpus(spark, sf), "row_id", "text")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return h.select(F.col("row_id").alias("doc_id"), F.round(norm, 6).alias("norm"), F.round(F.col("embedding")[0], 6).alias("first"), F.round(F.col("embedding")[63], 6).alias("last"))


@query
def rt_merge(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    half = lambda a: e.select("vec_id", F.slice("embedding", a, 32).alias("embedding"))
    q = lambda d: d.where(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "qid")
    x, y = half(1), half(33)
    a = R.nearest(q(x), x.withColumnRenamed("vec_id", "row_id"), 10)
    b = R.nearest(q(y), y.withColumnRenamed("vec_id", "row_id"), 10)
    return R.fuse(a, b, "merge").select("qid", F.col("row_id").alias("vec_id"), "vector_rank", "bm25_rank", "rank")


@query
def rt_recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    """Labels stand for documents: the wanted one of a question is its own."""
    e = _t(spark, sf, "embeddings")
    q = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), "embedding", "label")
    h = R.nearest(q.drop("label"), e.select(F.col("vec_id").alias("row_id"), "embedding"), 25).where("row_id <> qid")
    docs = R.distinct_docs(h.join(e.select(F.col("vec_id").alias("row_id"), F.col("label").alias("doc_id")), "row_id"))
    m = R.recall_mrr(docs, q.select("qid", F.col("label").alias("doc_id")))
    return m.select("qid", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query
def rt_multi_query(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of one label as sub-queries of one question, merged by reciprocal rank."""
    e = _t(spark, sf, "embeddings")
    q = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), "embedding", "label")
    h = R.nearest(q.drop("label"), e.select(F.col("vec_id").alias("row_id"), "embedding"), 24)
    f = R.fuse_queries(h.join(q.select("qid", F.col("label").alias("question_id")), "qid"))
    return f.select("question_id", F.col("row_id").alias("vec_id"), "rrf_score", "rank")


@query
def rt_context(spark: SparkSession, sf: str) -> DataFrame:
    """Rerank by overlap, distinct parents (the file a text came from), dynamic number of blocks."""
    q, d = _questions(spark, sf), _corpus(spark, sf)
    pool = R.bm25(q, d, 24).join(q.select("qid", F.col("text").alias("query")), "qid").join(d.select("row_id", "text", F.col("origin_id").alias("parent_id")), "row_id")
    ranked = R.rerank(pool.drop("score"), 12, score=R.overlap_score(F.col("query"), F.col("text")))
    parents = d.groupBy(F.col("origin_id").alias("parent_id")).agg(F.min("row_id").alias("doc_id")).withColumn("text", F.lit(""))
    b = R.context_blocks(ranked, parents, R.context_size(ranked))
    return b.select("qid", "rank", "parent_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"))


@query
def rt_context_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Without a reranker: pool order stays, scores count down, and the spread rule cannot hold."""
    q, d = _questions(spark, sf), _corpus(spark, sf)
    pool = R.bm25(q, d, 24).join(q.select("qid", F.col("text").alias("query")), "qid").join(d.select("row_id", F.col("origin_id").alias("parent_id")), "row_id").drop("score")
    ranked = R.rerank(pool, 12)
    take = R.context_size(ranked)
    return ranked.groupBy("qid").agg(F.max("rerank_score").alias("top"), F.min("rerank_score").alias("low")).join(take, "qid").select("qid", "top", "low", "take")


@query
def ch_chunks(spark: SparkSession, sf: str) -> DataFrame:
    from tarn.operators.chunking import chunk

    d = _t(spark, sf, "documents").select("doc_id", F.lit(0).alias("page"), X.strip_dirty(F.coalesce("text", F.lit(""))).alias("text"))
    return chunk(d).select("chunk_uid", "parent_id", F.length("text").alias("chars"), F.md5("text").alias("md5"))


@query
def ch_census(spark: SparkSession, sf: str) -> DataFrame:
    from tarn.operators.chunking import census, chunk

    return census(chunk(_t(spark, sf, "documents").select("doc_id", F.lit(0).alias("page"), F.coalesce("text", F.lit("")).alias("text"))))


# --- text functions -------------------------------------------------------------------------


@query
def tx_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return _t(spark, sf, "documents").select("doc_id", _long(X.dirty_count(t)).alias("removed"), F.md5(X.strip_dirty(t)).alias("md5"))


@query
def tx_sanitize_total(spark: SparkSession, sf: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    s = _t(spark, sf, "documents").select("origin_id", X.dirty_count(t).alias("n"), X.suspicious_names(t).alias("names"))
    return s.groupBy("origin_id").agg(F.sum("n").alias("removed"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), ",").alias("suspicious"))


@query
def tx_suspicious(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", F.array_join(X.suspicious_names(F.col("text")), ",").alias("names"))
    return d.where("names <> ''")


@query
def tx_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", _long(F.size("t")).alias("n"), _digest(F.col("t")).alias("md5"))


@query
def tx_bm25_terms(spark: SparkSession, sf: str) -> DataFrame:
    d = _corpus(spark, sf)
    w = R.term_weights(R.postings(d), d.count())
    return w.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def tx_sentences(spark: SparkSession, sf: str) -> DataFrame:
    p = _pairs(spark, sf).where("answer is not null").select("case_id", X.sentences(F.col("answer")).alias("s"))
    return p.select("case_id", _long(F.size("s")).alias("n"), _digest(F.col("s")).alias("md5"))


@query
def tx_leak(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select("id", F.round(X.leak_ratio(F.col("question"), F.col("ground_truth")), 6).alias("leak"), F.round(X.jaccard(F.col("question"), F.col("ground_truth")), 6).alias("jaccard"))


@query
def tx_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return X.simhash(_items(spark, sf), "id", "question")


@query
def tx_ratios(spark: SparkSession, sf: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return _t(spark, sf, "documents").select("doc_id", F.round(X.han_ratio(t), 6).alias("han_ratio"), X.is_english(t).alias("english"), X.passage_is_rich(t).alias("rich"))


@query
def tx_refusal(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("case_id", X.refuses(F.col("answer")).alias("refused"), X.refuses(F.col("answer"), attribution=True).alias("refused_attribution"))


@query
def tx_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    e = X.excerpt(F.coalesce("text", F.lit("")))
    return _t(spark, sf, "documents").select("doc_id", _long(F.length(e)).alias("chars"), F.md5(e).alias("md5"))


@query
def tx_stem(spark: SparkSession, sf: str) -> DataFrame:
    m = _t(spark, sf, "manifest").select("doc_id", X.stem(F.col("path")).alias("stem")).distinct()
    return m.select("doc_id", "stem", (F.col("doc_id") == F.col("stem")).alias("same"))


@query
def tx_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


@query
def tx_html(spark: SparkSession, sf: str) -> DataFrame:
    c = X.clean_html(F.coalesce("text", F.lit("")))
    return _t(spark, sf, "documents").select("doc_id", _long(F.length(c)).alias("chars"), F.md5(c).alias("md5"))


#: Topics of titles and texts for the classifier query (invented rules).
TOPICS = [("training", ["训练", "蒸馏", "预训练", "training"]), ("retrieval", ["检索", "召回", "重排", "rerank", "retrieval"]), ("shipping", ["运单", "派送", "物流", "parcel"]), ("money", ["退款", "金额", "运费", "refund", "price"])]


@query
def tx_topic(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select(X.topic(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")), TOPICS).alias("topic"))
    return d.groupBy("topic").agg(F.count("*").alias("n"))


@query
def tx_url_id(spark: SparkSession, sf: str) -> DataFrame:
    m = _t(spark, sf, "manifest").select("doc_id", F.concat(F.lit("https://example.org/"), F.when(F.col("n_parents") % 2 == 0, F.regexp_replace("path", r"\.txt$", ".html")).otherwise(F.col("path"))).alias("url")).distinct()
    return m.select("url", X.url_id(F.col("url")).alias("page_id"))


@query
def tx_question_norm(spark: SparkSession, sf: str) -> DataFrame:
    n = _items(spark, sf).select("id", X.question_norm(F.col("question")).alias("norm"))
    return n.groupBy("norm").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select(F.md5("norm").alias("norm"), "n", "first")


@query
def tx_citations(spark: SparkSession, sf: str) -> DataFrame:
    c = C.citations(_pairs(spark, sf), "case_id", "answer", F.lit(CONTEXTS))
    return c.select("case_id", _long(F.col("sent_ord")).alias("sent_ord"), F.md5("answer_sentence").alias("sentence"), _long(F.col("marker")).alias("marker"), "valid")


@query
def tx_citation_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = C.citation_stats(_pairs(spark, sf), "case_id", "answer", F.lit(CONTEXTS))
    return c.select("case_id", *[_long(F.col(x)).alias(x) for x in c.columns if x != "case_id"])


@query
def tx_invalid_marks(spark: SparkSession, sf: str) -> DataFrame:
    m = C.invalid_marks(F.coalesce("answer", F.lit("")), F.col("question"), F.lit(CONTEXTS))
    return _pairs(spark, sf).select("case_id", F.array_join(m, ",").alias("marks")).where("marks <> ''")


@query
def tx_evidence_json(spark: SparkSession, sf: str) -> DataFrame:
    s = "failed_criteria array<string>, supporting_docs array<string>, refused boolean, hyde_used boolean"
    e = _pairs(spark, sf).select(F.from_json("evidence", s).alias("e"))
    return e.groupBy(F.col("e.refused").alias("refused"), F.col("e.hyde_used").alias("hyde_used")).agg(F.count("*").alias("n"), _long(F.sum(F.size("e.failed_criteria"))).alias("failed"), _long(F.sum(F.size("e.supporting_docs"))).alias("docs"))


@query
def tx_busy_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Working-hour flag of a run's start: Monday to Friday, 9 to 12 and 14 to 18."""
    t = F.col("started_at")
    busy = (F.weekday(t) < 5) & (F.hour(t).between(9, 11) | F.hour(t).between(14, 17))
    return _results(spark, sf).groupBy(busy.alias("busy")).agg(F.count("*").alias("n"), F.round(F.round(F.sum("cost_cny"), 9), 4).alias("cost"))


@query
def tx_best_passage(spark: SparkSession, sf: str) -> DataFrame:
    i = _items(spark, sf)
    p = i.select(F.col("id").alias("doc_id"), F.posexplode("key_claims").alias("ord", "text"))
    b = Q.best_passage(i.select("id", F.col("id").alias("doc_id"), "question"), p)
    return b.select("id", "score", _long(F.col("ord")).alias("ord"))


@query
def tx_prefix_match(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose truth begins with the first claim of an item."""
    i = _items(spark, sf)
    e = i.select("id", F.get("key_claims", F.lit(0)).alias("excerpt")).where("excerpt is not null")
    return Q.prefix_match(e, i.where("ground_truth is not null").select(F.col("id").alias("text_id"), F.col("ground_truth").alias("text")), 120)


# --- evaluation -----------------------------------------------------------------------------


@query
def ev_criteria(spark: SparkSession, sf: str) -> DataFrame:
    c = _items(spark, sf).select(F.explode(E.criteria(F.lower("suite"), F.col("expected_behavior"), F.col("safety_type"))).alias("criterion"))
    return c.groupBy("criterion").agg(F.count("*").alias("n"))


@query
def ev_rule_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Rule metrics of answers, with the item's expected behaviour by its number."""
    i = _items(spark, sf).select(F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("k"), "suite", "expected_behavior", "injection_marker")
    p = _pairs(spark, sf).select(F.regexp_extract("case_id", r"(\d+)$", 1).cast("long").alias("k"), "case_id", "answer")
    m = E.rule_metrics(F.lower("suite"), F.col("expected_behavior"), F.col("answer"), F.col("injection_marker"), X.refuses(F.col("answer")))
    return p.join(i, "k", "left").select("case_id", *[c.alias(n) for n, c in m.items()])


@query
def ev_select(spark: SparkSession, sf: str) -> DataFrame:
    return E.select_items(_items(spark, sf), suite="quality", split="dev", types=["multi_hop", "adversarial"], limit=100).select("id", "type")


@query
def ev_summary(spark: SparkSession, sf: str) -> DataFrame:
    return E.summarise(_results(spark, sf), ["run_id"])


@query
def ev_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return E.by_type(_results(spark, sf))


@query
def ev_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    v = E.verdicts(_results(spark, sf), ["trace_id"])
    ok = F.count_if(F.col("verdict") == "pass")
    n = F.count_if(F.col("verdict").isin("pass", "fail"))
    lo, hi = S.wilson(ok, n)
    return v.groupBy("criterion").agg(F.count("*").alias("judged"), ok.alias("passed"), n.alias("valid"), F.round(S.rate(ok, n), 4).alias("pass_rate"), lo.alias("lo"), hi.alias("hi"))


@query
def ev_coverage(spark: SparkSession, sf: str) -> DataFrame:
    i = _items(spark, sf).withColumn("suite", F.lower("suite"))
    return E.judge_coverage(_results(spark, sf), i)


def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The first and the last run, an item's last row in each."""
    r = _results(spark, sf)
    one = Q.latest(r, ["run_id", "id"], F.col("started_at"), F.col("trace_id"))
    ends = r.agg(F.min("run_id").alias("lo"), F.max("run_id").alias("hi"))
    pick = lambda c: one.join(F.broadcast(ends.select(F.col(c).alias("run_id"))), "run_id")
    return pick("lo"), pick("hi")


@query
def ev_paired(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _runs(spark, sf)
    return E.paired_panel(E.verdicts(a, ["id"]), E.verdicts(b, ["id"]))


@query
def ev_paired_p(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _runs(spark, sf)
    return E.paired_panel(E.verdicts(a, ["id"]), E.verdicts(b, ["id"])).select("criterion", F.round(S.chi2_p(F.col("chi2")), 4).alias("p"))


@query
def ev_paired_refusal(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of false refusals: b newly refused, c no longer; and the change of mean recall."""
    a, b = _runs(spark, sf)
    m = lambda d, x: d.select("id", F.col("metrics.false_refusal").alias(f"f{x}"), F.col("metrics").getField("recall@5").alias(f"r{x}"))
    j = m(a, "x").join(m(b, "y"), "id")
    g = j.agg(F.count_if(F.col("fx").isNotNull() & F.col("fy").isNotNull()).alias("n"), F.count_if(~F.col("fx") & F.col("fy")).alias("b"), F.count_if(F.col("fx") & ~F.col("fy")).alias("c"), F.round(F.avg("rx"), 6).alias("x"), F.round(F.avg("ry"), 6).alias("y"))
    return g.select("n", "b", "c", S.mcnemar(F.col("b"), F.col("c")).alias("chi2"), E.mean_change(F.col("x"), F.col("y")).alias("recall_change"))


@query
def ev_cost_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each run until its cost passes a guard: the running sum before a row decides."""
    r = _results(spark, sf).select("run_id", "started_at", "trace_id", "cost_cny")
    r = running_sums(r, ["run_id"], ["started_at", "trace_id"], {"upto": F.coalesce("cost_cny", F.lit(0.0))}, Scratch(spark, "cost"))
    r = r.where(F.round(F.col("upto") - F.coalesce("cost_cny", F.lit(0.0)), 6) < 0.5)
    return r.groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.round(F.sum("cost_cny"), 9), 4).alias("cost"))


@query
def ev_pending(spark: SparkSession, sf: str) -> DataFrame:
    return Q.pending(_items(spark, sf).select("id"), _results(spark, sf), ["id"])


@query
def ev_next_run(spark: SparkSession, sf: str) -> DataFrame:
    """The next id of each day: the greatest number and one, three digits."""
    r = _results(spark, sf).select(F.split("run_id", "-")[0].alias("day"), F.split("run_id", "-")[1].cast("int").alias("k"))
    return r.groupBy("day").agg((F.max("k") + 1).alias("k")).select("day", F.concat("day", F.lit("-"), F.lpad(F.col("k").cast("string"), 3, "0")).alias("next_id"))


@query
def ev_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return E.calibrate(_labels(spark, sf).select("criterion", F.col("label").alias("human"), "judge"), ["criterion"])


@query
def ev_calibration_segments(spark: SparkSession, sf: str) -> DataFrame:
    return E.calibrate_with_total(_labels(spark, sf).select("segment", "criterion", F.col("label").alias("human"), "judge"))


@query
def ev_composed(spark: SparkSession, sf: str) -> DataFrame:
    c = _labels(spark, sf).select("criterion", F.col("label").alias("human"), E.composed(F.col("judge"), F.col("code_pass"), F.col("criterion")).alias("judge"))
    return E.calibrate(c, ["criterion"])


@query
def ev_interjudge(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of two judges on every fifth label row, sorted by item, criterion and annotator."""
    s = E.every_kth(_labels(spark, sf), 5, ["id", "criterion", "annotator"])
    return s.groupBy("criterion").agg(*E.agreement_of(F.col("judge"), F.col("judge2")))


@query
def ev_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of a score with a verdict at two thresholds: recall and correctness."""
    r = _results(spark, sf).select(F.col("metrics").getField("recall@5").alias("s"), F.col("judge").getItem("answer_correctness")["verdict"].alias("v")).where("s is not null and v in ('pass', 'fail')")
    t = r.select("s", "v", F.explode(F.array(F.lit(1.0), F.lit(0.5))).alias("threshold"))
    return t.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if((F.col("s") >= F.col("threshold")) == (F.col("v") == "pass")).alias("same"))


@query
def ev_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Failure classes of judged rows; context and fused documents are stated parts of the supporting ones."""
    i = _items(spark, sf).select("id", F.array_compact(F.transform("supporting_docs", lambda d: F.lower(F.trim(d)))).alias("support"))
    r = _results(spark, sf).join(i, "id").where(F.size("judge") > 0)
    part = lambda n: F.filter(F.coalesce("support", F.array().cast("array<string>")), lambda d: F.conv(F.substring(F.md5(d), 1, 4), 16, 10).cast("int") % n != 0)
    df = r.select("trace_id", "type", F.transform_values("judge", lambda k, v: v["verdict"]).alias("judge"), "support", part(3).alias("context_docs"), part(5).alias("fused_docs"), F.col("metrics.refused").alias("refused"), F.lit(False).alias("hyde_used"), F.array().cast("array<int>").alias("invalid_markers"))
    a = E.attribute(df)
    return a.select("trace_id", "attribution", F.array_join("support_in_context", ",").alias("in_context"), F.array_join("support_missing", ",").alias("missing"), F.array_join("support_never", ",").alias("never"))


@query
def ev_attribution_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).groupBy("attribution", "sub_label").agg(F.count("*").alias("n"))


# --- labels and sets ------------------------------------------------------------------------


@query
def qc_pass_rate(spark: SparkSession, sf: str) -> DataFrame:
    ok, bad = (F.count_if(F.col("label") == v) for v in ("pass", "fail"))
    return _labels(spark, sf).groupBy("criterion").agg(F.count("*").alias("n"), ok.alias("pass_n"), bad.alias("fail_n"), F.round(ok / F.count("*"), 4).alias("pass_rate"))


@query
def qc_segment_rate(spark: SparkSession, sf: str) -> DataFrame:
    l = _labels(spark, sf).withColumn("segment", F.coalesce("segment", F.lit("未分段")))
    p = F.count_if(F.col("label") == "pass")
    return l.groupBy("segment", "criterion").agg(F.count("*").alias("n"), p.alias("pass_n"), F.round(p / F.count("*"), 4).alias("pass_rate"))


@query
def qc_relabel(spark: SparkSession, sf: str) -> DataFrame:
    """First and last decided label of a person who labelled an item again."""
    c = _t(spark, sf, "calibration").select("id", "criterion", "annotator", _verdict(F.col("human.label")).alias("label"), "labelled_at").where("label is not null").distinct()
    g = c.groupBy("id", "criterion", "annotator").agg(F.count_distinct("labelled_at").alias("k"), F.min(F.struct("labelled_at", "label"))["label"].alias("a"), F.max(F.struct("labelled_at", "label"))["label"].alias("b")).where("k > 1")
    return g.agg(F.count("*").alias("compared"), F.count_if(F.col("a") == F.col("b")).alias("same_n"), F.count_if(F.col("a") != F.col("b")).alias("changed_n"), F.round(F.try_divide(F.count_if(F.col("a") == F.col("b")), F.count("*")), 4).alias("raw_agreement"))


@query
def qc_review(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes by reviewer of the judge spot check."""
    j = _t(spark, sf, "judge_spotcheck_v1").select("reviewer", "case_id", "criterion", "checked_at", _verdict(F.col("human_verdict")).alias("v")).distinct()
    return j.groupBy("reviewer").agg(F.count_if(F.col("v") == "pass").alias("pass_n"), F.count_if(F.col("v") == "fail").alias("reject_n"), F.count_if(F.col("v").isNull()).alias("undecided_n"), F.count("*").alias("total_n"))


@query
def qc_failures(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).where("attribution <> '无问题'").groupBy(F.col("attribution").alias("failure_class")).agg(F.count("*").alias("n"))


@query
def qc_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = _results(spark, sf)
    return r.groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.round(F.sum("cost_cny"), 9), 4).alias("total_cny"), F.round(F.round(F.avg("cost_cny"), 9), 4).alias("per_item_cny"), F.round(F.round(F.percentile("latency_ms", F.lit(0.5)), 6), 0).alias("p50_ms"), F.round(F.round(F.percentile("latency_ms", F.lit(0.95)), 6), 0).alias("p95_ms"))


@query
def qc_adjudication(spark: SparkSession, sf: str) -> DataFrame:
    """Who agrees with the judge, a column for each criterion."""
    j = _t(spark, sf, "judge_spotcheck_v1").select("case_id", "criterion", "reviewer", "checked_at", _verdict(F.col("human_verdict")).alias("h"), _verdict(F.col("judge_verdict")).alias("j")).distinct()
    j = j.withColumn("outcome", F.when(F.col("h").isNull() | F.col("j").isNull(), "open").when(F.col("h") == F.col("j"), "agree").otherwise("disagree"))
    names = ["answer_correctness", "citation_accuracy", "faithfulness", "oos_refusal"]
    return j.groupBy("outcome").pivot("criterion", names).count().fillna(0, names)


@query
def qc_latest_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf).select("id", "criterion", "annotator", "label")


@query
def qc_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Judge verdicts of two tables as a cache: one for each item, criterion and model, the latest."""
    c = _t(spark, sf, "calibration").select("id", "criterion", F.col("judge.model").alias("model"), _verdict(F.col("judge.verdict")).alias("v"), F.col("labelled_at").alias("at")).where("v is not null")
    j = _t(spark, sf, "judge_spotcheck_v1").select("id", "criterion", F.col("judge_model").alias("model"), _verdict(F.col("judge_verdict")).alias("v"), F.col("checked_at").alias("at")).where("v is not null")
    old = Q.latest(c, ["id", "criterion", "model"], F.col("at"), F.col("v"))
    return Q.upsert(old, Q.latest(j, ["id", "criterion", "model"], F.col("at"), F.col("v")), ["id", "criterion", "model"], "at").select("id", "criterion", "model", F.col("v").alias("verdict"))


@query
def qc_question_checks(spark: SparkSession, sf: str) -> DataFrame:
    return Q.question_checks(_items(spark, sf), F.col("ground_truth"))


@query
def qc_near_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Near fingerprints of questions; those of one fingerprint are paired with its first id."""
    return Q.near_fingerprints(X.simhash(_items(spark, sf), "id", "question"), "id", "fingerprint")


@query
def qc_problems(spark: SparkSession, sf: str) -> DataFrame:
    return Q.dataset_problems(_items(spark, sf), "quality")


@query
def qc_repeated(spark: SparkSession, sf: str) -> DataFrame:
    return Q.dataset_problems(_t(spark, sf, "business_v1").select("id", "suite", "split", "type", "question", "ground_truth", "key_claims", "supporting_docs", "expected_behavior", "safety_type", "injection_marker")).where("problem = 'id_repeated'")


#: Quotas of the five types (fixed values).
QUOTA = [("factual", 30, 22, 8), ("multi_hop", 15, 11, 4), ("colloquial", 10, 8, 2), ("out_of_scope", 10, 8, 2), ("adversarial", 15, 11, 4)]


@query
def qc_quota(spark: SparkSession, sf: str) -> DataFrame:
    quota = spark.createDataFrame(QUOTA, "type string, total long, dev long, holdout long")
    return Q.quota_problems(_items(spark, sf), quota)


@query
def qc_meta(spark: SparkSession, sf: str) -> DataFrame:
    i = _items(spark, sf)
    one = lambda c: i.groupBy(F.lit(c).alias("field"), F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return one("type").unionByName(one("split")).unionByName(one("expected_behavior"))


@query
def qc_unknown_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that items name as they are written and the manifest does not have."""
    d = _items(spark, sf).select(F.explode("supporting_docs").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    return d.join(_t(spark, sf, "manifest").select("doc_id").distinct(), "doc_id", "left_anti")


def _gates(spark: SparkSession, sf: str, most: int | None = None) -> DataFrame:
    i = _items(spark, sf)
    held = F.coalesce("split", F.lit("")) == "holdout"
    return Q.badcase_gates(i, i.where(held), F.col("ground_truth"), most)


@query
def qc_badcases(spark: SparkSession, sf: str) -> DataFrame:
    """Gates of new cases with a cap of 100 for each type, against the holdout items as the known set; those come out as regression rows."""
    return _gates(spark, sf, 100)


@query
def qc_badcase_gates(spark: SparkSession, sf: str) -> DataFrame:
    """The same gates without a cap."""
    return _gates(spark, sf)


@query
def sm_every_kth(spark: SparkSession, sf: str) -> DataFrame:
    return E.every_kth(_pairs(spark, sf).select("case_id"), 7, ["case_id"])


@query
def sm_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    i = _items(spark, sf).select("id", F.coalesce("type", F.lit("unknown")).alias("type"))
    return Q.round_robin(i, 3, "type", "id").select("id", "type", _long(F.col("bucket")).alias("bucket"))


@query
def sm_first_per(spark: SparkSession, sf: str) -> DataFrame:
    return Q.first_per(_items(spark, sf).select("id", "type"), "type", {"factual": 30, "multi_hop": 15, "colloquial": 10, "out_of_scope": 10, "adversarial": 15}, ["id"])


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return _results(spark, sf).where(F.size("judge") > 0).select("trace_id", "type", F.exists(F.map_values("judge"), lambda v: v["verdict"] == "fail").alias("failed"))


@query
def sm_failures_first(spark: SparkSession, sf: str) -> DataFrame:
    return Q.failures_first(_judged(spark, sf), F.col("failed"), 20, 3, ["trace_id"]).select("trace_id", "failed")


@query
def sm_controls(spark: SparkSession, sf: str) -> DataFrame:
    quota = {"out_of_scope": 2, "adversarial": 2, "factual": 3, "multi_hop": 3, "colloquial": 2}
    return Q.controls(_judged(spark, sf), F.col("failed"), quota, 12, "type", ["trace_id"]).select("trace_id", "failed")


@query
def sm_priority(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 rows: failed, then out of scope, then the rest, in order."""
    j = _judged(spark, sf)
    o = F.when(F.col("failed"), 0).when(F.col("type") == "out_of_scope", 1).otherwise(2)
    return j.withColumn("o", o).orderBy("o", "trace_id").limit(50).select("trace_id", F.col("o").cast("int").alias("priority"))


@query
def sc_manifest_new(spark: SparkSession, sf: str) -> DataFrame:
    """Idempotent load: one entry for each document and content, skipped deliveries apart."""
    m = _t(spark, sf, "manifest")
    loaded = m.where("status is null or status <> 'skipped'").select("doc_id", "content_hash").distinct()
    again = m.where("status = 'skipped'").select("doc_id", "content_hash").distinct()
    return again.join(loaded, ["doc_id", "content_hash"], "left").groupBy("doc_id").agg(F.count("*").alias("n"))


@query
def sc_order_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One text for each order, from orders, customers and lines."""
    o, c, l = (_t(spark, sf, n) for n in ("orders", "customer", "lineitem"))
    per = l.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.array_join(F.array_sort(F.collect_list(F.format_string("%03d:%d", "l_linenumber", "l_partkey"))), ";").alias("parts"))
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(per, o.o_orderkey == per.l_orderkey, "left")
    return j.select("o_orderkey", F.concat_ws("|", F.col("o_orderkey").cast("string"), F.coalesce("c_name", F.lit("—")), F.col("o_orderstatus"), F.coalesce("parts", F.lit("—"))).alias("text"))


@query
def sc_markdown_table(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers as a report shows them: none as a dash, small ones with four digits, others grouped with two."""
    m = _t(spark, sf, "manifest").groupBy("doc_id").agg(F.max("size_kb").alias("v"))
    return m.select("doc_id", F.when(F.col("v").isNull(), "—").when(F.abs("v") < 1, F.format_number("v", 4)).otherwise(F.format_number("v", 2)).alias("shown"))


@query
def st_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events in windows of an hour (an extension: the same expression serves streams)."""
    from tarn.streaming.events import windowed

    w = windowed(_t(spark, sf, "events"), "1 hour")
    return w.select(F.col("window.start").alias("start"), "event_type", "n", F.round(F.round("value", 9), 4).alias("value"))


@query
def st_sessions(spark: SparkSession, sf: str) -> DataFrame:
    from tarn.streaming.events import sessions

    s = sessions(_t(spark, sf, "events"), "30 minutes")
    return s.select("user_id", F.col("session_window.start").alias("start"), "n", F.round(F.round("value", 9), 4).alias("value"))


@query
def qc_fresh_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with enough text, one for each content."""
    d = _t(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("url"), "text")
    return Q.fresh_pages(d).select("url", "sha256")


@query
def qc_passed(spark: SparkSession, sf: str) -> DataFrame:
    """Items passed by any label of two tables."""
    a = _t(spark, sf, "calibration").select("id", _verdict(F.col("human.label")).alias("decision"))
    return Q.passed_reviews(a, _t(spark, sf, "judge_spotcheck_v1").select("id", _verdict(F.col("human_verdict")).alias("decision")))


@query
def qc_merge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct questions of each type; the multi-hop ones replaced by themselves and numbered anew."""
    i = _items(spark, sf).select(F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("qid"), "type", "question")
    i = i.groupBy("type", "question").agg(F.min("qid").alias("qid"))
    return Q.merge_candidates(i, i.where("type = 'multi_hop'")).select("qid", "type", F.md5("question").alias("question"))


@query
def ev_order_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of an item against the sentences of its truth: shared, and in place."""
    i = _items(spark, sf).where("ground_truth is not null")
    s = F.filter(F.split("ground_truth", "[。；]"), lambda x: x != "")
    a = F.transform(F.coalesce("key_claims", F.array().cast("array<string>")), lambda x: F.trim(x))
    return i.select("id", F.round(Q.overlap(F.array_distinct(a), F.array_distinct(s)), 6).alias("overlap"), F.round(Q.order_match(a, s), 6).alias("in_place"))


@query
def ev_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Item texts in the items and in the result rows: how far they agree."""
    a = _items(spark, sf).select("id", "question")
    b = _results(spark, sf).groupBy("id").agg(F.min("question").alias("question"))
    return Q.parity(a, b, ["id"], "question")
