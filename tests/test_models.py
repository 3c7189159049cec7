import asyncio

import pytest
from pyspark.sql import functions as F

from tarn.functions import records as J
from tarn.operators import curation as Q
from tarn.operators import evaluation as E
from tarn.operators import order as O
from tarn.operators import retrieval as R
from tarn.plans import models as M
from tarn.sources.files import sniff
from tarn.sources.sinks import run_report, write_text
from tarn.storage import Scratch
from tarn.streaming.answers import answer_async


def test_only_errors_that_may_pass_are_tried_again():
    calls = []

    def f(e):
        calls.append(1)
        raise e

    for error, n in ((M.HttpError(429), 3), (M.HttpError(503), 3), (M.HttpError(404), 1), (TimeoutError(), 3), (ValueError(), 1)):
        calls.clear()
        with pytest.raises(type(error)):
            M.with_retries(f, tries=3, wait=0, backoff=M.linear)(error)
        assert len(calls) == n
    assert [M.doubling(i) for i in range(3)] == [1, 2, 4] and [M.linear(i) for i in range(3)] == [2, 4, 6]


def test_a_failing_reranker_leaves_the_pool_order(spark):
    pool = spark.createDataFrame([(q, f"r{i}", i + 1, f"查询{q}", f"文{i}") for q in (1, 2) for i in range(5)], "qid int, row_id string, rank int, query string, text string")

    def model(query, texts, top):
        if query.endswith("2"):
            raise RuntimeError("down")
        return [(4, 0.9), (0, 0.1)]

    got = R.rerank_with(pool, model, 3).collect()
    one = sorted((x for x in got if x.qid == 1), key=lambda x: x["rank"])
    two = sorted((x for x in got if x.qid == 2), key=lambda x: x["rank"])
    assert [(x.row_id, x.rerank_score) for x in one] == [("r4", 0.9), ("r0", 0.1), ("r1", 0.0)] and one[0].error is None
    assert [(x.row_id, x.rerank_score) for x in two] == [("r0", 5.0), ("r1", 4.0), ("r2", 3.0)] and "down" in two[0].error


def test_embedders_differ_by_mode_and_fill_what_is_missing(spark):
    e = M.Embedder(lambda t: [[1.0, len(x)] for x in t][:-1], lambda t: [[2.0, 0.0] for _ in t], 2)
    d = spark.createDataFrame([(1, "甲乙"), (2, "丙")], "id int, t string").coalesce(1)
    assert {r.id: list(r.embedding) for r in e.of(d, "id", "t").collect()} == {1: [1.0, 2.0], 2: [0.0, 0.0]}
    assert {tuple(r.embedding) for r in e.of(d, "id", "t", "queries").collect()} == {(2.0, 0.0)}


def test_texts_of_several_encodings(spark):
    t = "中文内容" * 10
    rows = [("u", t.encode()), ("b", b"\xef\xbb\xbf" + t.encode()), ("g", t.encode("gb18030")), ("x", b"ab\xffc"), ("s", "短".encode())]
    d = spark.createDataFrame([(k, bytearray(b)) for k, b in rows], "k string, b binary")
    assert {r.k: r.t for r in d.select("k", sniff(F.col("b")).alias("t")).collect()} == {"u": t, "b": t, "g": t, "x": "abc", "s": "短"}


def test_a_file_is_replaced_at_once(spark, tmp_path):
    p = tmp_path / "CURRENT"
    for text in ("eins", "zwei"):
        write_text(spark, f"file://{p}", text)
        assert p.read_text() == text
    assert [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["CURRENT"]


def test_objects_in_free_text():
    assert J.balanced('x {"a": 1} {"verdict": "pass", "b": {"c": "}"}} y') == '{"verdict": "pass", "b": {"c": "}"}}'
    assert J.balanced('{broken {"verdict": 1}') == '{"verdict": 1}' and J.balanced("none") is None and J.balanced('{"verdict": ') is None
    assert J.fill("{a} {B} {}", {"a": "{b}"}) == "{b} {B} {}"
    with pytest.raises(KeyError):
        J.fill("{c}", {})


def test_places_and_sums_equal_a_sort(spark):
    rows = [(i % 3, (i * 37) % 101, float(i)) for i in range(500)]
    d = spark.createDataFrame(rows, "g int, k int, v double").repartition(7)
    s = Scratch(spark, "t")
    placed = sorted((r.p, (r.k, r.g, r.v)) for r in O.positions(d, ["k", "g", "v"], "p", s).collect())
    assert placed == list(enumerate(sorted((k, g, v) for g, k, v in rows)))
    got = {(r.g, r.k, r.v): r.s for r in O.running_sums(d, ["g"], ["k", "v"], {"s": F.col("v")}, s).collect()}
    for g in range(3):
        total = 0.0
        for k, v in sorted((k, v) for h, k, v in rows if h == g):
            total += v
            assert got[g, k, v] == pytest.approx(total)
    assert O.positions(d.limit(0), ["k"], "p", s).count() == 0
    odd = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0)], "g int, k int, v double")
    assert sorted(r.s for r in O.running_sums(odd, ["g"], ["k"], {"s": F.col("v")}, s).collect()) == [1.0, 3.0]


def test_the_measurement_segment_is_refused(spark):
    d = spark.createDataFrame([("tuning",), ("measurement",)], "segment string")
    with pytest.raises(PermissionError):
        E.measured(d, "measurement")
    assert E.measured(d, "measurement", allow_measurement=True).count() == 1 and E.measured(d, "tuning").count() == 1


def test_near_fingerprints_equal_brute_force(spark):
    import random

    r = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [r.getrandbits(64) for _ in range(40)]
    every = list(dict.fromkeys(base + [x ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 6))) for x in base for _ in range(3)]))
    d = spark.createDataFrame([(f"k{i:03d}", signed(x)) for i, x in enumerate(every)], "id string, f long")
    want = {(f"k{i:03d}", f"k{j:03d}") for i, x in enumerate(every) for j, y in enumerate(every) if i < j and (x ^ y).bit_count() <= 3}
    assert {tuple(x) for x in Q.near_fingerprints(d, "id", "f").collect()} == want


def test_reports_and_sessions():
    s = {"n": 3, "refused": 0.5, "refused_lo": 0.1, "refused_hi": 0.9, "refused_n": 2, "recall5": None, "mrr": 0.25, "cost": 1.5, "cost_per_item": 0.5, "p50_ms": 10.0, "p95_ms": 20.0}
    text = run_report("r1", s, [{"type": "factual", "n": 3, "refused": 1, "metric_pass": 0, "metric_total": 0}], {"expected": 4, "valid": 3, "coverage": 0.75}, aborted=True)
    assert "| refused | 0.500 | 0.100–0.900 | 2 |" in text and "| recall5 | — | — | — |" in text and "覆盖率 0.750" in text and "提前" in text

    async def pieces(_):
        for x in (("甲", None), ("乙", {"total": 3}), (None, None)):
            yield x

    assert asyncio.run(answer_async(pieces, "c")) == {"answer": "甲乙", "usage": {"total": 3}}


def test_tools_and_drafts(spark):
    assert '"required": ["query"]' in M.tools_json(M.tool("search_documents", "Suche", query="Text"))
    with pytest.raises(ValueError):
        M.tool("No Name", "x")
    d = spark.createDataFrame([("f", "甲"), ("f", "乙乙")], "type string, passage string")
    got = M.draft_questions(d, {"f": "{passage}"}, M.model_udf(lambda t: ['{"question": "问"}' if len(x) == 1 else "nichts" for x in t])).collect()
    assert [(x.question, x.key_claims) for x in got] == [("问", [])]


def test_files_of_other_kinds_are_refused_and_broken_ones_are_empty(spark):
    from tarn.sources.files import pages_of, pdf_pages

    d = spark.createDataFrame([("/a/x.txt", bytearray("文本".encode())), ("/a/y.PDF", bytearray(b"p"))], "path string, content binary")
    assert [(r.doc_id, r.text) for r in pages_of(d).collect()] == [("x", "文本")]
    with pytest.raises(Exception, match="no reader for"):
        pages_of(spark.createDataFrame([("/a/x.doc", bytearray(b"a"))], "path string, content binary")).collect()

    def reader():
        class Page:
            def __init__(self, text):
                self.text = text

            def extract_text(self):
                if self.text == "bad":
                    raise ValueError
                return self.text

        def pages(stream):
            got = stream.read().decode()
            if got == "broken":
                raise OSError
            return [Page(t) for t in got.split("|")]

        return pages

    d = spark.createDataFrame([("/a.pdf", bytearray(b"one|bad|two")), ("/b.pdf", bytearray(b"broken"))], "path string, content binary")
    got = pdf_pages(d, reader).collect()
    assert sorted((r.path, r.page, r.text) for r in got) == [("/a.pdf", 0, "one"), ("/a.pdf", 1, ""), ("/a.pdf", 2, "two"), ("/b.pdf", 0, "")]
    assert all(len(r.content_hash) == 64 for r in got)
