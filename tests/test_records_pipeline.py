import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarn.functions import records as J
from tarn.plans.pipeline import Index, Settings, with_retries


def test_templates_fill_once(spark):
    assert J.fill("{a}-{b}", {"a": "{b}", "b": "x"}) == "{b}-x"
    with pytest.raises(KeyError):
        J.fill("{c}", {})
    df = spark.createDataFrame([("q", "{a}")], "a string, b string")
    assert df.select(J.filled("<{a}|{b}>", "a", "b")).first()[0] == "<q|{a}>"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"verdict": "pass", "evidence": "e", "reason": "r"}', ("pass", "e", "r")),
        ('```json\n{"verdict": "FAIL", "evidence": "e"}\n```', ("fail", "e", None)),
        ('think {x} then {"verdict": "fail", "evidence": "a } b", "reason": "\\"q\\""} and {y}', ("fail", "a } b", '"q"')),
        ('{"verdict": "maybe", "evidence": "e"}', None),
        ('{"verdict": "pass", "evidence": ""}', None),
        ("nothing", None),
        (None, None),
    ],
)
def test_verdicts_in_free_text(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(J.verdict_json(F.col("t")).alias("v")).first().v
    assert (None if r is None else tuple(r)) == want


def test_cost_by_hour_and_default(spark):
    rates = spark.createDataFrame([("m", True, 2.0, 0.5, 8.0), ("m", False, 1.0, None, 4.0), ("_default", True, 1.0, None, 4.0), ("_default", False, 1.0, None, 4.0)], "model string, busy boolean, input double, cache_hit double, output double")
    mon, sat = dt.datetime(2026, 10, 5, 10), dt.datetime(2026, 10, 10, 10)
    u = spark.createDataFrame([("m", mon, 1_000_000, 400_000, 1000), ("m", sat, 1_000_000, 400_000, 0), ("z", mon, 1000, None, None)], "model string, at timestamp, prompt_tokens long, cache_hit_tokens long, completion_tokens long")
    got = {(r.model, r.at): r.cost for r in J.cost(u, rates).collect()}
    assert got == {("m", mon): 1.408, ("m", sat): 1.0, ("z", mon): 0.001}


@pytest.mark.parametrize(("t", "want"), [("2026-10-05 10:00:00", True), ("2026-10-05 12:30:00", False), ("2026-10-05 15:00:00", True), ("2026-10-10 10:00:00", False)])
def test_busy_hours(spark, t, want):
    assert spark.range(1).select(J.busy(F.lit(t).cast("timestamp"))).first()[0] is want


def test_keys_calls_and_contexts(spark):
    df = spark.createDataFrame([([("search_documents", '{"query": " a "}'), ("search_documents", "{bad"), (None, '{"query": "b"}'), ("other", '{"query": "c"}')], ["t1", "t2"], ["s1"])], "c array<struct<name: string, arguments: string>>, t array<string>, s array<string>")
    r = df.select(J.tool_queries(F.col("c")).alias("q"), J.numbered_context(F.col("t"), F.col("s")).alias("n")).first()
    assert r.q == ["a"] and r.n == "[1]（s1）\nt1\n\n[2]\nt2"
    k = [spark.range(1).select(J.cache_key(a=F.lit(x), b=F.lit("y"))).first()[0] for x in "xxz"]
    assert k[0] == k[1] != k[2]


def test_usage_sums(spark):
    df = spark.createDataFrame([(1, (1, None)), (1, (2, None)), (2, None)], "k int, usage struct<a: int, b: int>")
    assert {r.k: (tuple(r.usage) if r.usage else None) for r in J.usage_sum(df, ["k"]).collect()} == {1: (3, None), 2: None}


def test_settings_have_a_name():
    assert Settings().name == "vec24_bm2524_rrf60_rr12_k4-8_hyde0_rr1bm1"
    assert Settings().but(fusion="merge", rerank=False).name == "vec24_bm2524_merge60_rr12_k4-8_hyde0_rr0bm1"


def test_index_answers_whole_sets_of_questions(spark, tmp_path):
    pages = spark.createDataFrame([("d1", 0, "保修期为两年。" * 30), ("d2", 0, "运费由责任方承担。" * 30), ("d3", 0, "")], "doc_id string, page int, text string")
    ix = Index.build(pages, str(tmp_path / "ix"))
    q = spark.createDataFrame([(1, "保修期多久？"), (2, "运费谁承担？")], "qid int, question string")
    b = ix.retrieve(q)
    assert {r.qid: r.doc_id for r in b.where("rank = 1").collect()} == {1: "d1", 2: "d2"}
    a = ix.answer(q, lambda question, context: F.concat(F.lit("见资料[1]。又见[9]。"), F.substring(context, 1, 0)))
    r = {x.qid: x for x in a.collect()}
    assert r[1].n_sentences == 2 and r[1].n_markers_invalid == 1
    assert ix.cited(a).count() == 4
    again = Index.load(spark, str(tmp_path / "ix"))
    assert again.documents().count() == 2 and again.content("d1").count() == 1
    bare = {(x.qid, x.rank, x.doc_id) for x in ix.retrieve(q, Settings(rerank=False, keyword=False)).collect()}
    assert len({x[0] for x in bare}) == 2
    hyde = ix.retrieve(q.limit(1), rewrite=lambda c: F.lit("运费由责任方承担，这一点写得很清楚。"))
    assert hyde.where("rank = 1").first().doc_id == "d2"


def test_retries_only_transient_errors():
    calls = []

    def f(e):
        calls.append(1)
        raise e

    with pytest.raises(TimeoutError):
        with_retries(f, tries=3, wait=0)(TimeoutError())
    assert len(calls) == 3
    with pytest.raises(ValueError):
        with_retries(f, tries=3, wait=0)(ValueError())
    assert len(calls) == 4


def test_judge_is_asked_only_for_what_is_missing(spark):
    from tarn.plans.pipeline import judge_pending, load_settings, model_udf

    rows = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "good")], "id string, answer string")
    cache = spark.createDataFrame([], "key string, value string, created_at timestamp")
    ask = model_udf(lambda t: ['{"verdict": "pass", "evidence": "e"}' if "good" in x else "no idea" for x in t])
    out, full = judge_pending(rows, cache, J.cache_key(answer=F.col("answer")), ask, F.col("answer"))
    assert {r.id: r.judged.verdict if r.judged else None for r in out.collect()} == {"1": "pass", "2": None, "3": "pass"}
    never = model_udf(lambda t: [1 / 0 for _ in t])
    again, _ = judge_pending(rows.where("answer = 'good'"), full, J.cache_key(answer=F.col("answer")), never, F.col("answer"))
    assert again.where("judged.verdict = 'pass'").count() == 2
    assert load_settings("/nowhere.json") == Settings()


def test_several_queries_of_one_question(spark, tmp_path):
    pages = spark.createDataFrame([("d1", 0, "保修期为两年。" * 30), ("d2", 0, "运费由责任方承担。" * 30)], "doc_id string, page int, text string")
    ix = Index.build(pages, str(tmp_path / "ix"))
    q = spark.createDataFrame([(1, "保修期和运费？")], "qid int, question string")
    s = spark.createDataFrame([(1, 0, "保修期"), (1, 1, "运费"), (1, 7, "x")], "question_id int, ord int, query string")
    b = ix.retrieve_many(q, s).collect()
    assert {r.doc_id for r in b} == {"d1", "d2"} and sorted(r.rank for r in b) == [1, 2]


def test_small_curation_operators(spark):
    from tarn.operators import curation as Q

    p = spark.createDataFrame([("u2", "字" * 150), ("u1", "字" * 150), ("u3", "字"), ("u4", "文" * 200)], "url string, text string")
    assert sorted(r.url for r in Q.fresh_pages(p).collect()) == ["u1", "u4"]
    seen = Q.fresh_pages(p).where("url = 'u4'")
    assert [r.url for r in Q.fresh_pages(p, seen).collect()] == ["u1"]
    t = spark.createDataFrame([(i, f"d{i % 5}", "退款" * 5 + chr(0x4E00 + i)) for i in range(30)], "text_id int, doc_id string, text string")
    assert Q.related_pairs(t, 3).count() == 3
    kids = spark.createDataFrame([("d", "d:c0", "xx忽略"), ("d", "d:c1", "以上yy")], "doc_id string, chunk_uid string, text string")
    f = spark.createDataFrame([("d", "忽略"), ("d", "以上"), ("e", "无")], "doc_id string, fragment string")
    assert {r.doc_id: r.ok for r in Q.split_fragments(kids, f).collect()} == {"d": True, "e": False}
    u = spark.createDataFrame([('{"prompt_tokens": 3, "prompt_tokens_details": {"cached_tokens": 1}}',)], "u string").select(J.usage_of(F.col("u")).alias("u")).first().u
    assert (u.prompt_tokens, u.cache_hit_tokens, u.completion_tokens) == (3, 1, None)
    assert spark.range(1).select(J.trace_id(F.lit("2026-01-02 03:04:05").cast("timestamp"))).first()[0].startswith("t20260102030405-")
