"""Queries over models behind plain functions, records and files: deterministic fakes stand for the models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.catalog import CONTEXTS, QUERIES, _corpus, _items, _labels, _long, _pairs, _questions, _results, _runs, _t, query
from tarn.functions import records as J
from tarn.functions import text as X
from tarn.operators import citations as C
from tarn.operators import curation as Q
from tarn.operators import evaluation as E
from tarn.operators import retrieval as R
from tarn.oracles import ORACLE
from tarn.oracles_models import MORE
from tarn.plans import models as M
from tarn.storage import Scratch

ORACLE |= MORE


# --- fakes ----------------------------------------------------------------------------------


def _share_of_characters(query_: str, texts: list[str], top: int) -> list[tuple[int, float]]:
    q = set(query_)
    return [(i, len(q & set(t)) / max(len(q), 1)) for i, t in enumerate(texts)]


def _verdict_of(texts: list[str]) -> list[str]:
    say = lambda v: "```json\n" + json.dumps({"verdict": v, "evidence": "e"}) + "\n```"
    return [say("pass") if "。" in t else say("fail") if "[" in t else "说不清" for t in texts]


def _verdicts_of(texts: list[str]) -> list[str]:
    one = lambda ok: {"verdict": "PASS" if ok else "fail", "evidence": "e"}
    return [json.dumps({"a": one("。" in t), "b": one("[" in t)}) if len(t) > 20 else '{"a": {"verdict": "pass"}}' for t in texts]


def _draft_of(texts: list[str]) -> list[str]:
    return ['{"skip": true}' if len(t) % 3 == 0 else json.dumps({"question": f" 问{len(t)} ", "key_claims": ["x", ""]}, ensure_ascii=False) for t in texts]


def _check_of(texts: list[str]) -> list[str]:
    return ["看不懂" if len(t) % 7 == 0 else json.dumps({"answerable": True, "traceable": len(t) % 2 == 0, "unambiguous": True}) for t in texts]


def _rewrite_of(texts: list[str]) -> list[str]:
    if any("吗" in t for t in texts):
        raise TimeoutError
    return [f"改写：{t}" for t in texts]


def _plan_of(text: str) -> list[str]:
    if "吗" in text:
        raise TimeoutError
    return text.split("，")


# --- models ---------------------------------------------------------------------------------


@query
def rt_rerank_model(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword pools reranked by a model, the best three of each."""
    q, d = _questions(spark, sf), _corpus(spark, sf)
    pool = R.bm25(q, d, 24).drop("score").join(q.select("qid", F.col("text").alias("query")), "qid").join(d.select("row_id", "text"), "row_id")
    r = R.rerank_with(pool, _share_of_characters, 3)
    return r.select("qid", F.col("row_id").alias("doc_id"), "pool_rank", F.round("rerank_score", 6).alias("score"), "rank")


@query
def md_judge(spark: SparkSession, sf: str) -> DataFrame:
    """A judge asked for each answer; texts without a decided verdict stay open."""
    from tarn.plans.pipeline import judge_pending

    cache = spark.createDataFrame([], "key string, value string, created_at timestamp")
    p = _pairs(spark, sf).select("case_id", F.coalesce("answer", F.lit("")).alias("answer"))
    out, _ = judge_pending(p, cache, J.cache_key(case=F.col("case_id")), M.model_udf(_verdict_of), F.col("answer"))
    return out.select("case_id", F.col("judged.verdict").alias("verdict"))


@query
def md_annotate(spark: SparkSession, sf: str) -> DataFrame:
    """A second annotator: two criteria in one call."""
    p = _pairs(spark, sf).select("case_id", F.coalesce("answer", F.lit("")).alias("answer"))
    a = M.annotate(p, "{answer}", ["answer"], ["a", "b"], M.model_udf(_verdicts_of))
    return a.select("case_id", F.col("verdicts")["a"]["verdict"].alias("a"), F.col("verdicts")["b"]["verdict"].alias("b"), F.col("error").isNotNull().alias("failed"))


@query
def md_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Questions drafted for items of two types."""
    i = _items(spark, sf).where("type in ('factual', 'multi_hop')").select("id", "type", F.col("ground_truth").alias("passage"))
    d = M.draft_questions(i, {"factual": "甲{passage}", "multi_hop": "乙乙{passage}"}, M.model_udf(_draft_of))
    return d.select("id", "type", "question", _long(F.size("key_claims")).alias("claims"))


@query
def md_verify(spark: SparkSession, sf: str) -> DataFrame:
    i = _items(spark, sf).select("id", "type", "question", "ground_truth", "key_claims", F.lit("").alias("passage"))
    return M.verify_questions(i, "{question}{ground_truth}{claims}{passage}!", M.model_udf(_check_of)).select("id", "verified", "reason")


@query
def md_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Questions rewritten; where the rewriter fails the question stays."""
    return _items(spark, sf).select("id", F.md5(M.model_udf(_rewrite_of, batch=1, fall_back=True)(F.col("question"))).alias("md5"))


@query
def md_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Search queries of each question, at most four; the question itself where the planner fails."""
    p = M.planned_queries(_items(spark, sf).select(F.col("id").alias("qid"), "question"), _plan_of)
    return p.select("question_id", _long(F.col("ord")).alias("ord"), F.md5("query").alias("query"))


@query
def rt_merge_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of several sub-queries: the best score of each parent, in order."""
    e = _t(spark, sf, "embeddings").select(F.col("label").alias("question_id"), (F.col("vec_id") % 97).alias("parent_id"), F.round(F.col("embedding")[0].cast("double"), 6).alias("rerank_score"))
    return R.merge_blocks(e)


# --- records --------------------------------------------------------------------------------


@query
def tx_doc_of(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "manifest").select("doc_id", X.doc_of(F.concat("doc_id", F.lit(":c00001"))).alias("doc")).distinct()


@query
def tx_context(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of an item as numbered context blocks."""
    b = _items(spark, sf).select(F.col("id").alias("qid"), F.posexplode("key_claims").alias("pos", "text")).withColumn("rank", F.col("pos") + 1)
    return R.context_text(b).select("qid", F.md5("context").alias("md5"))


@query
def tx_numbered(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).where(F.size("key_claims") > 0).select("id", F.md5(J.numbered_context(F.col("key_claims"), F.col("supporting_docs"))).alias("md5"))


@query
def tx_fill(spark: SparkSession, sf: str) -> DataFrame:
    """A template over two columns; other braces stay."""
    return _items(spark, sf).select("id", F.md5(J.filled("问：{question}\n答：{ground_truth}\n{Keep} {}", "question", "ground_truth")).alias("md5"))


@query
def tx_verdict_json(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts read back from a judge's free text."""
    j = F.to_json(F.struct(F.col("judge.verdict").alias("verdict"), F.col("judge.evidence").alias("evidence"), F.col("judge.reason").alias("reason")))
    v = J.verdict_json(F.concat(F.lit("判定 {如下}：\n```json\n"), j, F.lit("\n```\n")))
    return _t(spark, sf, "calibration").select(v["verdict"].alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query
def tx_verdicts_json(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of two criteria read from one object; none unless both are decided."""
    both = F.to_json(F.struct(F.struct(F.col("judge.verdict").alias("verdict")).alias("a"), F.struct(F.col("judge2.verdict").alias("verdict")).alias("b")))
    v = J.verdicts_json(F.concat(F.lit("```json\n"), both, F.lit("\n```")), ["a", "b"])
    return _t(spark, sf, "calibration").select(v["a"]["verdict"].alias("a"), v["b"]["verdict"].alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


@query
def tx_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "calibration").select("id", "criterion").distinct()
    return c.select("id", "criterion", J.cache_key(id=F.col("id"), criterion=F.col("criterion")).alias("key"))


@query
def tx_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Usage read from JSON and summed by run; what no record has is null."""
    n = F.coalesce(F.length("question"), F.lit(0))
    raw = F.format_string('{"prompt_tokens": %d, "prompt_tokens_details": {"cached_tokens": %d}}', n, n % 7)
    u = J.usage_sum(_results(spark, sf).select("run_id", J.usage_of(raw).alias("usage")), ["run_id"])
    return u.select("run_id", "usage.prompt_tokens", "usage.cache_hit_tokens", "usage.completion_tokens")


def _rates(spark: SparkSession) -> DataFrame:
    rows = [("factual", False, 2.0, 1.0, 3.0), ("factual", True, 4.0, None, 6.0), ("_default", False, 1.0, None, 2.0), ("_default", True, 2.0, 1.0, 4.0)]
    return spark.createDataFrame(rows, "model string, busy boolean, input double, cache_hit double, output double")


def _used(spark: SparkSession, sf: str) -> DataFrame:
    n = F.coalesce(F.length("question"), F.lit(0))
    return _results(spark, sf).select("trace_id", F.coalesce("type", F.lit("none")).alias("model"), F.col("started_at").alias("at"), (n * 10).alias("prompt_tokens"), n.alias("cache_hit_tokens"), (n % 11).alias("completion_tokens"), (n * 10 + n % 11).alias("total_tokens"))


@query
def ev_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Cost of each trace by its type's rates, those of working hours apart."""
    return J.cost(_used(spark, sf), _rates(spark)).select("trace_id", "cost")


@query
def ev_stage_costs(spark: SparkSession, sf: str) -> DataFrame:
    stages = _used(spark, sf).withColumn("stage", F.explode(F.array(F.lit("hyde"), F.lit("rerank"), F.lit("generation"))))
    return J.stage_costs(stages.where((F.col("stage") != "hyde") | (F.col("model") == "factual")), _rates(spark), 3.0)


@query
def tx_tool_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Queries of search calls, one call for each claim."""
    calls = F.transform(F.coalesce("key_claims", F.array().cast("array<string>")), lambda c: F.struct(F.lit("search_documents").alias("name"), F.to_json(F.struct(c.alias("query"))).alias("arguments")))
    return _items(spark, sf).select("id", F.md5(F.array_join(J.tool_queries(calls), "|")).alias("md5"))


@query
def tx_citation_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Citations with the context their mark numbers; the question stands for the context."""
    p = _pairs(spark, sf)
    ctx = p.select("case_id", F.explode(F.sequence(F.lit(1), F.lit(CONTEXTS))).alias("rank"), F.col("question").alias("text")).withColumns({"doc_id": F.concat(F.lit("d"), F.col("rank")), "parent_id": F.concat(F.lit("p"), F.col("rank"))})
    c = C.with_sources(C.citations(p, "case_id", "answer", F.lit(CONTEXTS)), ctx, "case_id")
    return c.select("case_id", _long(F.col("sent_ord")).alias("sent_ord"), _long(F.col("marker")).alias("marker"), "source_doc", "parent_id", F.md5("supporting_snippet").alias("snippet"))


# --- sets and runs --------------------------------------------------------------------------


@query
def ev_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    p = _pairs(spark, sf).select("attribution").distinct()
    return p.select("attribution", E.suggestion(F.col("attribution")).alias("suggestion"))


@query
def ev_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-hop items in the first and the last run."""
    a, b = (d.select("id", "type", F.col("metrics.false_refusal").alias("false_refusal"), F.col("judge").getItem("answer_correctness")["verdict"].alias("verdict")) for d in _runs(spark, sf))
    return E.type_slice(a, b)


@query
def ev_segment(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the tuning segment; the measurement segment is refused."""
    return E.measured(_labels(spark, sf), "tuning").groupBy("criterion").agg(F.count("*").alias("n"))


@query
def qc_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Runs as records of a registry, flattened again."""
    r = _results(spark, sf).groupBy("run_id").agg(F.count("*").alias("n"), F.max("latency_ms").alias("p95_ms"), F.min("split").alias("split"))
    record = F.to_json(F.struct("run_id", F.struct("n", "split").alias("dataset"), F.struct("p95_ms").alias("latency")))
    return E.flat_runs(r.select(record.alias("value"))).select("run_id", "n", "split", "p95_ms", "recall5")


@query
def qc_united(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping sets: where both have an item, that of the later set holds."""
    i = _items(spark, sf)
    return Q.united(i.where("split = 'dev'").select("id", F.lit("first").alias("of")), i.where("type = 'adversarial'").select("id", F.lit("later").alias("of")))


@query
def qc_filled_quotas(spark: SparkSession, sf: str) -> DataFrame:
    q = {"factual": (30, 22), "multi_hop": (15, 11), "colloquial": (10, 8), "out_of_scope": (10, 8), "adversarial": (15, 11)}
    return Q.filled_quotas(_items(spark, sf).select("id", "type"), q, ["id"]).select("id", "type", "split")


@query
def st_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Streamed pieces as whole answers, with the usage of the last piece that has one."""
    from tarn.streaming.answers import sessions_of

    p = _items(spark, sf).select(F.col("id").alias("session"), F.posexplode("key_claims").alias("ord", "text"))
    a = sessions_of(p.withColumn("usage", F.when(F.col("ord") % 2 == 0, F.col("ord") + 1)))
    return a.select("session", F.md5("answer").alias("answer"), _long(F.col("usage")).alias("usage"))


# --- files ----------------------------------------------------------------------------------


@query
def sc_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """Items written as JSON lines and read by their schema."""
    from tarn.sources.files import read_jsonl
    from tarn.sources.sinks import append_jsonl

    scratch = Scratch(spark, "jsonl")
    append_jsonl(_items(spark, sf), f"{scratch.root}/items")
    r = read_jsonl(spark, f"{scratch.root}/items")
    return r.select("id", "type", F.md5("question").alias("question"), _long(F.size(F.coalesce("key_claims", F.array().cast("array<string>")))).alias("claims"))


@query
def sc_form(spark: SparkSession, sf: str) -> DataFrame:
    """A form for people: open labels go out as CSV, come back filled in and are merged."""
    from tarn.sources.files import read_csv
    from tarn.sources.sinks import merge_form, write_form

    scratch = Scratch(spark, "form")
    rows = _labels(spark, sf).select("id", "criterion", "annotator", "label")
    write_form(rows.where("label is null").withColumn("label", F.lit(" fail ")), f"{scratch.root}/form")
    form = read_csv(spark, f"{scratch.root}/form/*.csv")
    return merge_form(rows, form, ["id", "criterion", "annotator"], ["label"]).groupBy("criterion", "label").agg(F.count("*").alias("n"))


__all__ = ["ORACLE", "QUERIES"]
