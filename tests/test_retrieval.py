from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tarn.operators import retrieval as R

DATA = Path("/root/testdata/sf0.001")


def ranks(spark, *ids, q=1):
    return spark.createDataFrame([(q, x, i + 1) for i, x in enumerate(ids)], "qid int, row_id string, rank int")


def test_reciprocal_rank_fusion(spark):
    f = {r.row_id: r for r in R.fuse(ranks(spark, "a", "b", "c"), ranks(spark, "c", "a")).collect()}
    assert sorted(f, key=lambda x: f[x].rank) == ["a", "c", "b"]
    assert f["a"].rrf_score == round(1 / 61 + 1 / 62, 6) and f["c"].rrf_score == round(1 / 63 + 1 / 61, 6) and f["b"].rrf_score == round(1 / 62, 6)
    assert f["b"].bm25_rank is None and f["c"].vector_rank == 3


def test_ties_go_to_the_vector_list(spark):
    f = R.fuse(ranks(spark, "a"), ranks(spark, "b")).orderBy("rank").collect()
    assert [r.row_id for r in f] == ["a", "b"]


def test_merge_keeps_the_first(spark):
    f = R.fuse(ranks(spark, "a", "b"), ranks(spark, "c", "a"), "merge").orderBy("rank").collect()
    assert [r.row_id for r in f] == ["a", "b", "c"]


@pytest.mark.parametrize(("query", "scores", "take"), [("长" * 40, [0.9, 0.5, 0.4, 0.3, 0.2, 0.1], 6), ("短", [0.50, 0.49, 0.48, 0.47, 0.46], 5), ("短", [0.9, 0.5, 0.4, 0.1], 4), ("短", [0.9, 0.8], 4)])
def test_context_size(spark, query, scores, take):
    r = spark.createDataFrame([(1, query, i + 1, s) for i, s in enumerate(scores)], "qid int, query string, rank int, rerank_score double")
    assert R.context_size(r).first()["take"] == take


def test_bm25_pads_in_corpus_order_and_breaks_ties_by_row(spark):
    d = spark.createDataFrame([(0, "x y"), (1, "a b"), (2, "a b"), (3, "z"), (4, "w")], "row_id long, text string")
    q = spark.createDataFrame([(1, "a"), (2, "q"), (3, "")], "qid int, text string")
    h = R.bm25(q, d, 4).orderBy("qid", "rank").collect()
    assert [r.row_id for r in h if r.qid == 1] == [1, 2, 0, 3]
    assert [r.row_id for r in h if r.qid == 2] == [0, 1, 2, 3]
    assert not [r for r in h if r.qid == 3]


def test_nearest_is_exact_and_stable(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(9)], "row_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [0.0, 0.0])], "qid int, embedding array<double>")
    assert [r.row_id for r in R.nearest(q, v, 5).orderBy("rank").collect()] == [0, 3, 6, 1, 4]


def test_recall_and_reciprocal_rank(spark):
    f = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3)], "qid int, doc_id string, rank int")
    d = R.distinct_docs(f)
    s = lambda *x: spark.createDataFrame([(1, y) for y in x], "qid int, doc_id string")
    assert R.recall_mrr(d, s("a")).first()[1:] == (1.0, 1.0)
    assert R.recall_mrr(d, s("b", "c")).first()[1:] == (0.5, 0.5)
    assert R.recall_mrr(d, s("c")).first()[1:] == (0.0, 0.0)


def test_blocks_skip_missing_parents_and_keep_the_first(spark):
    r = spark.createDataFrame([(1, 1, "p1", 0.9), (1, 2, "p1", 0.8), (1, 3, "gone", 0.7), (1, 4, "p2", 0.6), (1, 5, None, 0.5)], "qid int, rank int, parent_id string, rerank_score double")
    p = spark.createDataFrame([("p1", "d", "一"), ("p2", "d", "二")], "parent_id string, doc_id string, text string")
    t = spark.createDataFrame([(1, 4)], "qid int, take int")
    b = R.context_blocks(r, p, t)
    assert [(x.rank, x.parent_id, x.rerank_score) for x in b.orderBy("rank").collect()] == [(1, "p1", 0.9), (2, "p2", 0.6)]
    assert R.context_text(b).first().context == "【参考资料1】\n一\n\n【参考资料2】\n二"


def test_histogram_is_normalised(spark):
    d = spark.createDataFrame([(1, "aab"), (2, ""), (3, None)], "id int, t string")
    h = {r.id: r.embedding for r in R.histogram(d, "id", "t").collect()}
    assert h[1][ord("a") % 64] == pytest.approx(2 / 5**0.5) and h[1][ord("b") % 64] == pytest.approx(1 / 5**0.5)
    assert sum(h[2]) == sum(h[3]) == 0.0


def test_kept_are_the_smallest_of_all_batches(monkeypatch):
    monkeypatch.setattr(R, "WAITING", 10)
    r = np.random.default_rng(2)
    score = r.integers(0, 9, (7, 300)).astype(float)
    score[score == 8] = np.inf
    score[6, 4:] = np.inf
    kept = R._Kept(7, 5, 9)
    rows = r.permutation(300)
    for a in range(0, 300, 40):
        kept.add(score[:, a : a + 40], rows[a : a + 40])
    got = [x for b in kept.result("row_id", pa.int64()) for x in zip(*b.to_pydict().values(), strict=True)]
    assert got == [(i, *x) for i in range(7) for x in [(y, s) for s, y in sorted(zip(score[i].tolist(), rows.tolist(), strict=True)) if s < np.inf][:5]]


@pytest.mark.parametrize("dense", [0.0, 0.2, 9.0])
@pytest.mark.parametrize("idf", [[0.5, 1.0, 2.0], [0.5, -1.0, 0.0]])
def test_keyword_scores_equal_the_formula(monkeypatch, dense, idf):
    monkeypatch.setattr(R, "DENSE", dense)
    asked = [{"a": 1, "b": 2}, {"c": 1}, {"a": 3, "c": 1}]
    flat = sorted(("abc".index(t), i, float(n)) for i, q in enumerate(asked) for t, n in q.items())
    s = R._Scorer(3, ["a", "b", "c"], np.array(idf), np.array([0.5, 0.2, 0.1]), np.array([x[1] for x in flat], dtype=np.int32), np.array([x[2] for x in flat]), np.searchsorted([x[0] for x in flat], range(4)))
    texts = [["a", "x", "a"], [], ["b", "c", "y"], ["x"], ["c"]]
    got = np.full((3, 5), np.inf)
    for at, x in s.of(pa.array(texts, pa.list_(pa.string())), np.array([1.5, 0, 1.5, 0.5, 0.5])):
        got[:, at] = np.where(x <= s.top, x, np.inf)
    for i, q in enumerate(asked):
        for j, t in enumerate(texts):
            both = [w for w in q if w in t]
            want = -sum(q[w] * idf["abc".index(w)] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / 2)) for w in both) if both else np.inf
            assert got[i, j] == pytest.approx(want)


def test_many_questions_about_the_same_words_keep_to_the_bound():
    """20,000 questions of 40 common words: all pairs of a few hundred chunks were gigabytes."""
    import tracemalloc

    n, words = 20_000, [f"w{i}" for i in range(200)]
    r = np.random.default_rng(3)
    who = np.concatenate([np.sort(r.choice(n, n // 5, replace=False)) for _ in words]).astype(np.int32)
    chunks = pa.array([r.choice(words, 150, replace=False).tolist() for _ in range(500)], pa.list_(pa.string()))
    tracemalloc.start()
    s = R._Scorer(n, words, np.ones(200), np.full(200, 0.75), who, np.ones(len(who)), np.arange(201) * (n // 5))
    kept = R._Kept(n, 24, 9, s.top)
    for at, x in s.of(chunks, np.ones(500)):
        kept.add(x, np.arange(500)[at])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6 and sum(len(b) for b in kept.result("row_id", pa.int64())) == n * 24


def test_long_texts_are_counted_some_characters_at_a_time():
    """A thousand texts of 20,000 characters at once were a gigabyte."""
    import tracemalloc

    texts = ["ab" * 10_000, "", "c"] * 1000
    tracemalloc.start()
    h = R.histogram_of(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and h.shape == (3000, R.DIM)
    assert (h == np.tile(np.vstack([R.histogram_of([t]) for t in texts[:3]]), (1000, 1))).all()


def test_vectors_are_made_where_they_are_compared(spark):
    """Vectors by one Python function and their comparison by another were two processes for each task."""
    from tarn.catalog import QUERIES

    d = spark.createDataFrame([(i, "abc"[: i % 4] * (i % 5) if i else None) for i in range(40)], "row_id long, text string")
    q = R.histogram(spark.createDataFrame([(1, "ab"), (2, "")], "qid int, text string"), "qid", "text")
    got, want = R.nearest(q, d, 9, of=R.histogram_of), R.nearest(q, R.histogram(d, "row_id", "text"), 9)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 18
    with pytest.raises(Exception, match="length"):
        R.nearest(q, d, 9, of=lambda texts: [[0.0]] * len(texts)).collect()
    if not DATA.exists():
        pytest.skip("no test tables here")
    plan = QUERIES["rt_hybrid"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
