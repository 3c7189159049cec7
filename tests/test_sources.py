import json

import pytest

from tarn.functions.text import passage_is_rich
from tarn.sources import files, sinks
from tarn.streaming import answers, events, ingest


def test_text_files_in_two_encodings(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("甲​乙".encode())
    (tmp_path / "sub/b.txt").write_bytes("订单已发货".encode("gbk"))
    (tmp_path / ".hidden.txt").write_bytes(b"x")
    (tmp_path / "c.md").write_bytes(b"x")
    p = {r.doc_id: r for r in files.pages_of(files.discover(spark, [str(tmp_path), str(tmp_path)])).collect()}
    assert set(p) == {"a", "b"} and p["a"].text == "甲乙" and p["a"].chars_removed == 1 and p["b"].text == "订单已发货"


def test_jsonl_is_strict_or_skips(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text(json.dumps({"id": "a", "suite": "quality", "more": 1}) + "\n\n{broken\n")
    assert [r.id for r in files.read_jsonl(spark, str(f), strict=False).collect()] == ["a"]
    with pytest.raises(Exception, match="not a record"):
        files.read_jsonl(spark, str(f)).collect()


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,备注\n1,好\n".encode())
    (tmp_path / "b.csv").write_bytes("id,备注\n1,好\n".encode("gbk"))
    for n in "ab":
        assert files.read_csv(spark, str(tmp_path / f"{n}.csv")).first().asDict() == {"id": "1", "备注": "好"}


def test_atom_markdown_html(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<feed><entry><id>http://x/abs/2401.00001v2</id><title>A\nB</title><summary>S</summary><published>2024-01-02T00:00:00Z</published><link href="h" title="abs"/><link href="p" title="pdf"/></entry></feed>')
    assert tuple(files.read_atom(spark, str(tmp_path / "f.xml")).first()) == ("2401.00001", "A B", "S", "2024-01-02", "p")
    md = spark.createDataFrame([(1, "intro\n## One\nx\ny\n## Two \n"), (2, None), (3, "none")], "k int, t string")
    assert [(r.k, r.ord, r.title, r.body) for r in files.markdown_sections(md, "k", "t").collect()] == [(1, 1, "One", "x\ny"), (1, 2, "Two", "")]
    h = spark.createDataFrame([("<h1>T</h1><p>a<br>b</p><script>z</script><li>c</li>",), (None,)], "h string").select(files.html_article("h").alias("x")).collect()
    assert h[0].x.title == "T" and "a" in h[0].x.body and "z" not in h[0].x.body and h[1].x.title == ""


def test_snapshot_refuses_mismatched_rows(spark, tmp_path):
    c = spark.createDataFrame([("a",), ("b",)], "chunk_uid string")
    v = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "chunk_uid string, embedding array<double>")
    root = str(tmp_path / "ix")
    sinks.write_snapshot({"children": c, "vectors": v}, root)
    assert sinks.read_snapshot(spark, root, dim=1)["children"].count() == 2
    with pytest.raises(ValueError):
        sinks.read_snapshot(spark, root, dim=2)
    sinks.write_snapshot({"children": c, "vectors": v.limit(1)}, root)
    with pytest.raises(ValueError):
        sinks.read_snapshot(spark, root)


def test_forms_and_records(spark, tmp_path):
    rows = spark.createDataFrame([("a", "c", None), ("b", "c", "old")], "id string, criterion string, label string")
    sinks.append_jsonl(rows, str(tmp_path / "r"))
    sinks.append_jsonl(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 4
    sinks.write_form(rows, str(tmp_path / "form"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "form")).count() == 2
    form = spark.createDataFrame([("a", "c", " pass ")], "id string, criterion string, label string")
    assert {r.id: r.label for r in sinks.merge_form(rows, form, ["id", "criterion"], ["label"]).collect()} == {"a": "pass", "b": "old"}
    assert sinks.markdown(spark.createDataFrame([("x", 0.5, 1234.5, None)], "a string, b double, c double, d int")).split("\n")[2] == "| x | 0.5000 | 1,234.50 | — |"


def test_stream_ingest_is_idempotent(spark, tmp_path):
    land, store = tmp_path / "land", str(tmp_path / "store")
    land.mkdir()
    (land / "a.txt").write_text("第一篇。" * 60 + "​")
    (land / "e.txt").write_text(" \n")
    for _ in range(2):
        ingest.ingest_stream(spark, str(land), store, str(tmp_path / "ck")).awaitTermination()
    assert ingest.verify(spark, store)["ok"]
    (land / "b.txt").write_text("第二篇。")
    ingest.ingest_stream(spark, str(land), store, str(tmp_path / "ck")).awaitTermination()
    m = {r.doc_id: r for r in ingest.manifest(spark, store).collect()}
    assert m["a"].status == "loaded" and m["a"].chars_removed == 1 and m["e"].status == "failed" and m["b"].n_children == 1
    # the same content again, then another one for the same document
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "a.txt").write_text("第一篇。" * 60 + "​")
    (tmp_path / "more" / "b.txt").write_text("改了。")
    ingest.ingest_batch(files.discover(spark, [str(tmp_path / "more")]), store, 99)
    assert [(r.doc_id, r.status) for r in ingest.manifest(spark, store).where("batch = 99").collect()] == [("b", "conflict")]
    assert ingest.verify(spark, store) == {"documents": 2, "parents": 2, "children": 2, "ok": True}


def test_answer_protocol():
    gen = lambda c: iter(["a", "b"])
    assert [k for k, _ in answers.stream_answer([{"rank": 1}], gen, "c")] == ["retrieval", "delta", "delta", "done"]
    assert [k for k, _ in answers.stream_answer([], gen, "")] == ["retrieval", "done"]
    assert [k for k, _ in answers.stream_answer([], gen, "", empty=True)] == ["done"]

    def broken(c):
        raise RuntimeError("x")
        yield

    assert list(answers.sse(answers.stream_answer([{}], broken, "")))[-1].startswith("event: error")


def test_event_stream_equals_batch(spark, tmp_path):
    e = spark.sql("select timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,id*7,0) ts, id % 3 as user_id, 'v' as event_type, cast(id as double) as value from range(50)")
    e.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = events.windowed(s, "30 minutes", late="1 hour").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    f = lambda d: sorted((r.window.start, r.n, r.value) for r in d.collect())
    assert f(spark.table("w")) == f(events.windowed(e, "30 minutes"))


def test_passages_by_length(spark):
    from pyspark.sql import functions as F

    p = spark.createDataFrame([("d", 1, "文" * 500), ("d", 0, "字" * 450), ("d", 2, "短"), ("d", 3, "1" * 500)], "doc_id string, ord int, text string")
    got = files.passages(p, passage_is_rich(F.col("text"))).first()
    assert [x[0] for x in got.passages] == ["字", "文"]
