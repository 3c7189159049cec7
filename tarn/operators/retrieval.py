"""Batch retrieval: a table of questions against tables of chunks, top k by window."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.text import tokens
from tarn.session import batches_of, ship
from tarn.storage import Scratch

#: Questions that are held at once, at 600 bytes each; more are worked on in blocks.
BROADCAST_QUESTIONS = 20_000
#: Terms of questions that are held at once.
QUESTION_TERMS = 1_000_000
#: Scores that a task holds at once, at 8 bytes each, and hits that wait to be sorted in. Chunks that come to Python at once.
CELLS, WAITING = 3_000_000, 200_000
CHUNKS_AT_ONCE = 500
#: Characters that are counted at once, at about 30 bytes each; one more text at most.
CHARS_AT_ONCE = 1_000_000
#: A term is scored by matrix product if at least this share of pairs of question and chunk meet in it.
DENSE = 0.01
DIM = 64
# Constants of BM25 and the context heading below are fixed values.
K1, B, EPSILON = 1.5, 0.75, 0.25


def histogram_of(texts: list[str], dim: int = DIM) -> np.ndarray:
    """A row for each text: counts of code point modulo ``dim``, L2-normalised; zeros for an empty text."""
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    n = np.zeros((len(texts), dim))
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // CHARS_AT_ONCE)) + 1).tolist(), len(texts)]
    for a, z in itertools.pairwise(cuts):
        cp = np.frombuffer("".join(texts[a:z]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        row = np.repeat(np.arange(z - a), size[a:z])
        n[a:z] = np.bincount(row * dim + cp % dim, minlength=(z - a) * dim).reshape(z - a, dim)
    norm = np.sqrt((n * n).sum(axis=1, keepdims=True))
    return np.divide(n, norm, out=n, where=norm > 0)


def embed(df: DataFrame, key: str, text: str, vectors_of: Callable[[list[str]], Sequence], batch: int = 1024) -> DataFrame:
    """(key, embedding) of every row by a model of texts, in batches as they lie: no row moves for it."""

    def run(texts: pd.Series) -> pd.Series:
        clean = [t or "" for t in texts]
        return pd.Series([v for i in range(0, len(clean), batch) for v in vectors_of(clean[i : i + batch])], dtype=object)

    ship(df.sparkSession)
    return df.select(key, F.pandas_udf(run, "array<double>")(F.col(text)).alias("embedding"))


def histogram(df: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """Deterministic embedding (key, embedding): ``histogram_of`` of each row's text; a null text is empty."""
    return embed(df, key, text, lambda texts: list(histogram_of(texts, dim)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _blocks(questions: DataFrame, qid: str, size: int, most: int) -> list[DataFrame]:
    """Questions in blocks by a hash of their id, about ``most`` of ``size`` in each: what the driver holds of them at once is bound."""
    n = math.ceil(size / most)
    return [questions] if n <= 1 else [questions.where(F.pmod(F.xxhash64(qid), F.lit(n)) == i) for i in range(n)]


def _numbers(spark: SparkSession, ids: list, kind: T.DataType, qid: str) -> DataFrame:
    """(_i, id): the places of questions in their block."""
    return spark.createDataFrame([(i, x) for i, x in enumerate(ids)], T.StructType([T.StructField("_i", T.LongType()), T.StructField(qid, kind)]))


def _named(hits: DataFrame, ids: list, kind: T.DataType, qid: str) -> DataFrame:
    """Hits by a question's place in its block, with its id instead."""
    return hits.join(F.broadcast(_numbers(hits.sparkSession, ids, kind, qid)), "_i").drop("_i")  # a block of questions


class _Kept:
    """The k smallest scores of each question over all batches of a task, ties by row: what a task holds and gives does not grow with its rows."""

    def __init__(self, n: int, k: int, digits: int, top: float = np.finfo(float).max):
        self.k, self.digits, self.slack, self.top = k, digits, 2.0 * 10.0**-digits, top
        self.limit = np.full(n, top)  # no score above it is among the k smallest
        self.best: list[np.ndarray] | None = None
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.room = 0, max(WAITING, n * k)

    def add(self, score: np.ndarray, rows: np.ndarray) -> None:
        """``score`` has a row for each question and a column for each of ``rows``; what is above ``top`` is no hit."""
        step = max(1, 262_144 // max(1, score.shape[1]))
        for a in range(0, len(score), step):
            part = score[a : a + step]
            at = np.flatnonzero((part <= self.limit[a : a + step, None]).ravel())
            if len(at):
                who, col = np.divmod(at, score.shape[1])
                found = ((who + a).astype(np.int32), np.round(part.ravel()[at], self.digits), rows[col])
                if np.bincount(who).max() > self.k:
                    found = self._first(*found)
                self.new.append(found)
                self.waiting += len(found[0])
        if self.waiting > self.room:
            self._merge()

    def _first(self, who: np.ndarray, score: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = np.unique(rows, return_inverse=True)[1] if rows.dtype == object else rows
        order = np.lexsort((key, score, who))
        own = who[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
        order = order[place < self.k]
        return who[order], score[order], rows[order]

    def _merge(self) -> None:
        held = [self.best] * (self.best is not None) + self.new
        self.new, self.waiting = [], 0
        if held:
            self.best = self._first(*(np.concatenate(x) for x in zip(*held, strict=True)))
            who, score, _ = self.best
            last = np.flatnonzero(np.append(who[1:] != who[:-1], True))
            full = np.bincount(who, minlength=len(self.limit))[who[last]] == self.k
            self.limit[who[last[full]]] = np.minimum(score[last[full]] + self.slack, self.top)

    def result(self, row: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        self._merge()
        for a in range(0, len(self.best[0]) if self.best else 0, 50_000):
            who, score, rows = (x[a : a + 50_000] for x in self.best)
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(rows, kind), pa.array(score, pa.float64())], names=["_i", row, "score"])


def _merged(parts: list[DataFrame], order: list[Column], k: int, qid: str) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(*order))).where(F.col("rank") <= k)


def nearest(questions: DataFrame, vectors: DataFrame, k: int, qid: str = "qid", row: str = "row_id", digits: int = 9, of: Callable[[list[str]], Sequence] | None = None) -> DataFrame:
    """Exact k nearest vectors of each question by squared L2 distance: rows (qid, row_id, score, rank).

    A stated set of questions against all vectors: a block of questions goes to every task as one
    matrix, some vectors at a time are one matrix product of at most ``CELLS`` scores, and only the k nearest of each
    question leave a task. Ties go to the lower row. Vectors of a length other than the questions' are an error.

    With ``of``, a model of texts, ``vectors`` has ``text`` instead of ``embedding`` and a text's vector is made where it is
    compared: a second Python function in the same stage would be a second process for each task. A null text is empty.
    """
    ship(questions.sparkSession)
    kind = dict(vectors.dtypes)[row]
    v = vectors.select(row, F.col("embedding").cast("array<double>").alias("embedding") if of is None else "text")
    parts = []
    for block in _blocks(questions.select(qid, F.col("embedding").cast("array<double>").alias("embedding")), qid, questions.count(), BROADCAST_QUESTIONS):
        held = block.collect()
        ids = [r[0] for r in held]
        m = np.array([r[1] for r in held], dtype=np.float64).reshape(len(held), -1)

        def run(batches, n=len(ids), m=m):
            own, wide = (m * m).sum(axis=1), max(1, min(1024, CELLS // max(1, n)))
            kept, kind = _Kept(n, k, digits), None
            def matrix(c):
                """Vectors of one column as rows."""
                if of is not None:
                    x = np.asarray(of([t or "" for t in c.to_pylist()]), dtype=np.float64)
                    same = x.shape == (len(c), m.shape[1])
                else:
                    x = c.flatten().to_numpy(zero_copy_only=False)
                    same = not c.null_count and len(x) == len(c) * m.shape[1] and not pc.any(pc.not_equal(pc.list_value_length(c), m.shape[1])).as_py()
                if not same:
                    raise ValueError(f"vectors must have the questions' length, {m.shape[1]}")
                return x.reshape(len(c), -1)

            for b in batches if n else ():
                kind = b.column(0).type
                rows = b.column(0).to_numpy(zero_copy_only=False)
                for a in range(0, len(b), wide):
                    y = matrix(b.column(1)[a : a + wide])
                    d = m @ y.T
                    d *= -2
                    d += own[:, None]
                    d += (y * y).sum(axis=1)
                    kept.add(np.maximum(d, 0.0, out=d), rows[a : a + wide])
            yield from kept.result(row, kind)

        parts.append(_named(v.mapInArrow(run, f"_i long, {row} {kind}, score double"), ids, questions.schema[qid].dataType, qid).select(qid, row, "score"))
    return _merged(parts, [F.col("score"), F.col(row)], k, qid)


def postings(chunks: DataFrame, row: str = "row_id", text: str = "text") -> DataFrame:
    """(term, row_id, tf, dl): how often each chunk has each term, and its length in terms."""
    t = chunks.select(F.col(row).alias("row_id"), tokens(F.col(text)).alias("_t"))
    t = t.select("row_id", F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    return t.groupBy("term", "row_id", "dl").agg(F.count("*").alias("tf"))


def term_weights(posts: DataFrame, n: int) -> DataFrame:
    """(term, df, idf): ln(n - df + 1/2) - ln(df + 1/2); where negative, a quarter of the mean over all terms, negatives included."""
    d = posts.groupBy("term").agg(F.count("*").alias("df"))
    raw = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    d = d.withColumn("_raw", raw)
    mean = d.agg(F.avg("_raw").alias("_mean"))
    return d.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("_raw") < 0, EPSILON * F.col("_mean")).otherwise(F.col("_raw")).alias("idf"))  # one row of means


class Keywords:
    """What keyword search needs of a corpus, made once: tokens (row_id, dl, tokens), terms (term, df, idf), rows and mean length."""

    def __init__(self, tokens_: DataFrame, terms: DataFrame, rows: int | None = None, mean: float | None = None):
        self.tokens, self.terms = tokens_, terms
        if rows is None:
            t = tokens_.agg(F.count("*").alias("n"), F.sum("dl").alias("len")).first()
            rows, mean = t.n, (t.len or 0) / max(t.n, 1) or 1.0
        self.rows, self.mean = rows, mean

    @classmethod
    def of(cls, chunks: DataFrame, scratch: Scratch) -> Keywords:
        """``chunks`` has row_id (the corpus order) and text; texts are tokenised once, into a written table."""
        t = chunks.select("row_id", tokens(F.col("text")).alias("tokens")).select("row_id", F.size("tokens").alias("dl"), "tokens")
        t = scratch.cut(t, "tokens")
        made = cls(t, t)
        once = t.select("row_id", F.explode(F.array_distinct("tokens")).alias("term"))
        made.terms = scratch.cut(term_weights(once, made.rows), "terms")
        return made


class _Scorer:
    """Negated BM25 scores of chunks for a block of ``n`` questions, whose lists by term are ``who`` and ``times`` from ``first``."""

    def __init__(self, n: int, names: list[str], idf: np.ndarray, share: np.ndarray, who: np.ndarray, times: np.ndarray, first: np.ndarray):
        self.n, self.names, self.idf, self.who, self.times, self.first = n, pa.array(names, pa.string()), idf, who, times, first
        #: With positive weights what shares no term is what scores 0; else shared terms are counted.
        self.signed = bool((idf <= 0).any())
        self.top = np.finfo(float).max if self.signed else -np.finfo(float).tiny
        met = share * np.diff(first) / max(1, n)
        dense = np.flatnonzero(met >= DENSE)
        dense = np.sort(dense[np.argsort(-met[dense], kind="stable")][: CELLS // max(1, n)])
        self.place = np.full(len(names), -1)
        self.place[dense] = np.arange(len(dense))
        self.matrix = np.zeros((n, len(dense)))
        for i, j in enumerate(dense.tolist()):
            self.matrix[who[first[j] : first[j + 1]], i] = times[first[j] : first[j + 1]]

    def of(self, tokens_: pa.ListArray, length: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Ranges of chunks and their scores, a row for each question; inf or 0 where no term is shared. ``length`` is relative to the mean."""
        words = tokens_.flatten()
        no = pc.fill_null(pc.index_in(words, self.names.cast(words.type)), -1).to_numpy(zero_copy_only=False)
        size = pc.fill_null(pc.list_value_length(tokens_), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        wide = max(1, min(1024, CELLS // max(1, self.n)))
        for a in range(0, len(size), wide):
            z = min(a + wide, len(size))
            t, doc = no[ends[a] : ends[z]], np.repeat(np.arange(z - a), size[a:z])
            cell, tf = np.unique(t[t >= 0].astype(np.int64) * (z - a) + doc[t >= 0], return_counts=True)
            if len(cell):
                term, doc = np.divmod(cell, z - a)
                w = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[a:z][doc]))
                score = self._sums(term, doc, -w, z - a)
                if self.signed:
                    score[self._sums(term, doc, np.ones(len(w)), z - a) == 0] = np.inf
                yield slice(a, z), score
                del score

    def _sums(self, term: np.ndarray, doc: np.ndarray, w: np.ndarray, wide: int) -> np.ndarray:
        """The sum of times a question has a term and the term's weight in a chunk; terms ascend, a chunk once in each."""
        at = self.place[term]
        part = np.zeros((self.matrix.shape[1], wide))
        part[at[at >= 0], doc[at >= 0]] = w[at >= 0]
        out = self.matrix @ part
        term, doc, w = term[at < 0], doc[at < 0], w[at < 0]
        cuts = [*np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)]).tolist(), len(term)]
        for x, y in itertools.pairwise(cuts):
            j = self.first[term[x]], self.first[term[x] + 1]
            out[self.who[j[0] : j[1], None], doc[x:y]] += self.times[j[0] : j[1], None] * w[x:y]
        return out


def bm25(questions: DataFrame, chunks: DataFrame | Keywords, k: int, qid: str = "qid", text: str = "text", pad: bool = True, digits: int = 9) -> DataFrame:
    """The k best chunks of each question by BM25 over the whole corpus: rows (qid, row_id, score, rank).

    ``chunks`` has row_id (the corpus order) and text, or is the ``Keywords`` of such a table. Repeated question terms count
    again. Ties and, with ``pad``, the places that no matching chunk fills
    (score 0) go to the lowest rows of the corpus. A question without terms has no hits.
    Scores are rounded to ``digits``, as sums of doubles depend on their order.

    Questions go to every task as lists by term, with the weights of their terms. Some chunks at a time are
    counted for these terms only; their scores are one matrix of at most ``CELLS``: terms that many questions and many chunks
    have by a matrix product, the others term by term. Only the k best of each question leave a task: no chunk
    is shuffled and no pair of question and chunk is ever a row. The hits are a written table.
    """
    spark = questions.sparkSession
    ship(spark)
    scratch = Scratch(spark, "keywords")
    corpus = chunks if isinstance(chunks, Keywords) else Keywords.of(chunks, scratch)
    toks, avgdl = corpus.tokens, corpus.mean
    row_type = dict(toks.dtypes)["row_id"]
    q = questions.select(qid, F.explode(tokens(F.col(text))).alias("term")).groupBy(qid, "term").agg(F.count("*").alias("times"))
    q = scratch.cut(q, "asked")
    parts = []
    size = max(q.count(), q.select(qid).distinct().count() * (QUESTION_TERMS // BROADCAST_QUESTIONS))
    for block in _blocks(q, qid, size, QUESTION_TERMS):
        ids = [r[0] for r in block.select(qid).distinct().collect()]
        known = corpus.terms.join(block.select("term").distinct(), "term").select("term", "df", "idf").toArrow().to_pandas().sort_values("term")  # terms of a block of questions
        names, idf, share = known["term"].tolist(), known["idf"].to_numpy(dtype=np.float64), known["df"].to_numpy(dtype=np.float64) / max(1, corpus.rows)
        numbered = _numbers(spark, ids, questions.schema[qid].dataType, "_id")
        flat = block.join(F.broadcast(numbered), F.col(qid).eqNullSafe(F.col("_id"))).select("_i", "term", F.col("times").cast("double").alias("times")).toArrow().to_pandas()  # a block of questions
        flat["term"] = pd.Index(names, dtype=object).get_indexer(flat["term"])
        flat = flat[flat["term"] >= 0].sort_values(["term", "_i"])
        who, times = flat["_i"].to_numpy(dtype=np.int32), flat["times"].to_numpy(dtype=np.float64)
        first = np.searchsorted(flat["term"].to_numpy(), np.arange(len(names) + 1))

        def run(batches, n=len(ids), names=names, idf=idf, share=share, who=who, times=times, first=first):
            score = _Scorer(n, names, idf, share, who, times, first)
            kept, kind = _Kept(n, k, digits, score.top), None
            for b in batches if names else ():
                kind = b.column(0).type
                rows = b.column(0).to_numpy(zero_copy_only=False)
                for at, x in score.of(b.column(2), b.column(1).to_numpy(zero_copy_only=False) / avgdl):
                    kept.add(x, rows[at])
                    del x
            yield from kept.result("row_id", kind)

        parts.append(_named(toks.select("row_id", "dl", "tokens").mapInArrow(run, f"_i long, row_id {row_type}, score double"), ids, questions.schema[qid].dataType, qid).select(qid, "row_id", (F.lit(0.0) - F.col("score")).alias("score")))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    if pad:
        first_rows = toks.select("row_id").orderBy("row_id").limit(2 * k)
        fill = q.select(qid).distinct().join(F.broadcast(first_rows))  # 2 k rows for each question
        # zeros sort before any negative score: only the first rows can fill the list, those that match no term
        matched = toks.join(F.broadcast(first_rows), "row_id").select("row_id", F.explode(F.array_distinct("tokens")).alias("term")).join(q, "term").select(qid, "row_id").distinct()
        hits = fill.join(matched, [qid, "row_id"], "left_anti").select(qid, "row_id", F.lit(0.0).alias("score")).unionByName(hits)
    hits = _merged([hits], [F.desc("score"), F.col("row_id")], k, qid)
    with batches_of(spark, CHUNKS_AT_ONCE):  # a chunk has all its tokens in its row
        return scratch.finish(hits)


def fuse(vector: DataFrame, keyword: DataFrame, strategy: str = "rrf", k: int = 60, qid: str = "qid", uid: str = "row_id") -> DataFrame:
    """One ranked list of two: rows (qid, uid, rrf_score, vector_rank, bm25_rank, rank).

    ``rrf``: sum of 1 / (k + rank) over both lists, ties by vector rank, then by keyword
    rank. ``merge``: the vector list, then what only the keyword list has; no score.
    A union and one aggregation, no outer join; a chunk twice in a list adds twice.
    """
    both = vector.select(qid, uid, F.lit("v").alias("_route"), "rank").unionByName(keyword.select(qid, uid, F.lit("k").alias("_route"), "rank"))
    one = lambda r: F.max(F.when(F.col("_route") == r, F.col("rank")))
    f = both.groupBy(qid, uid).agg(F.sum(1.0 / (k + F.col("rank"))).alias("_s"), one("v").alias("vector_rank"), one("k").alias("bm25_rank"))
    first = [F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank")]
    order = [F.desc(F.round("_s", 12)), *first] if strategy == "rrf" else first
    score = F.round("_s", 6) if strategy == "rrf" else F.lit(None).cast("double")
    return f.select(qid, uid, score.alias("rrf_score"), "vector_rank", "bm25_rank", F.row_number().over(Window.partitionBy(qid).orderBy(*order)).alias("rank"))


def fuse_queries(fused: DataFrame, k: int = 60, question: str = "question_id", uid: str = "row_id") -> DataFrame:
    """One list of several sub-queries of a question: the same sum over each sub-query's fused order."""
    s = fused.groupBy(question, uid).agg(F.sum(1.0 / (k + F.col("rank"))).alias("_s"), F.min("rank").alias("best"))
    w = Window.partitionBy(question).orderBy(F.desc(F.round("_s", 12)), "best", uid)
    return s.select(question, uid, F.round("_s", 6).alias("rrf_score"), F.row_number().over(w).alias("rank"))


def overlap_score(query: Column, text: Column) -> Column:
    """Deterministic reranker: the share of the query's distinct characters that the text has."""
    chars = lambda c: F.array_remove(F.array_distinct(F.split(c, "")), "")
    return F.size(F.array_intersect(chars(query), chars(text))) / F.greatest(F.size(chars(query)), F.lit(1))


def rerank(pool: DataFrame, top: int = 12, qid: str = "qid", score: Column | None = None) -> DataFrame:
    """The ``top`` chunks of each pool by ``score`` (default: overlap of query and text), ties in pool order.

    Without a score, as when a reranker fails, the pool order stays and scores count down from the pool's size.
    """
    if score is None:
        score = F.count("*").over(Window.partitionBy(qid)) - F.col("rank") + 1
    s = pool.withColumn("rerank_score", score.cast("double")).withColumnRenamed("rank", "pool_rank")
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("rerank_score"), "pool_rank"))).where(F.col("rank") <= top)


def rerank_with(pool: DataFrame, model: Callable[[str, list[str], int], Sequence[tuple[int, float]]], top: int = 12, qid: str = "qid") -> DataFrame:
    """The ``top`` chunks of each pool by a model, which gives (place in the pool, score) pairs of (query, texts, top).

    A chunk that the model leaves out has score 0; ties stay in pool order. Where the model raises, the
    pool order stays, scores count down from the pool's size, and the column ``error`` says why (else null).
    A pool is a few dozen rows of one question.
    """
    ship(pool.sparkSession)
    rest = [c for c in pool.columns if c != "rank"]
    schema = pool.select(*rest, F.col("rank").cast("int").alias("pool_rank"), F.lit(0.0).alias("rerank_score"), F.lit(0).alias("rank"), F.lit("").alias("error")).schema
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        score, error = np.zeros(len(pdf)), None
        try:
            for i, x in model(str(pdf["query"].iloc[0]), pdf["text"].tolist(), min(top, len(pdf))):
                score[i] = x
        except Exception as e:  # noqa: BLE001
            score, error = np.arange(len(pdf), 0, -1, dtype=float), f"{type(e).__name__}: {e}"
        pdf["pool_rank"] = pdf.pop("rank").astype(np.int32)
        pdf["rerank_score"], pdf["error"] = score, error
        pdf = pdf.iloc[np.argsort(-score, kind="stable")[:top]].copy()
        pdf["rank"] = np.arange(1, len(pdf) + 1, dtype=np.int32)
        return pdf[schema.names]

    return pool.groupBy(qid).applyInPandas(run, schema)


def context_size(ranked: DataFrame, base: int = 4, most: int = 8, long_query: int = 36, close: float = 0.12, qid: str = "qid") -> DataFrame:
    """(qid, take): the number of context blocks: more for long queries and for scores that lie close together."""
    g = ranked.groupBy(qid).agg(F.max(F.length("query")).alias("_len"), F.count("rerank_score").alias("_n"), (F.max(F.when(F.col("rank") <= 12, F.col("rerank_score"))) - F.min(F.when(F.col("rank") <= 12, F.col("rerank_score")))).alias("_spread"))
    k = base + F.when(F.col("_len") >= long_query, 2).otherwise(0) + F.when((F.col("_n") >= 4) & (F.col("_spread") < close), 1).otherwise(0)
    limit = F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.lit(base))
    return g.select(qid, F.greatest(F.lit(base), F.least(k, F.lit(most), limit)).cast("int").alias("take"))


def context_blocks(ranked: DataFrame, parents: DataFrame, take: DataFrame, qid: str = "qid") -> DataFrame:
    """Distinct parents in reranked order, as many as ``take`` says: rows (qid, rank, parent_id, doc_id, text, rerank_score).

    Children without a parent, or whose parent is missing, are passed over.
    """
    best = ranked.where("parent_id is not null").groupBy(qid, "parent_id").agg(F.min("rank").alias("_r"), F.max_by("rerank_score", -F.col("rank")).alias("rerank_score"))
    b = best.join(parents.select("parent_id", "doc_id", "text"), "parent_id").join(take, qid)
    b = b.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy("_r"))).where("rank <= take")
    return b.select(qid, "rank", "parent_id", "doc_id", "text", "rerank_score")


def merge_blocks(blocks: DataFrame, question: str = "question_id") -> DataFrame:
    """Blocks of several sub-queries of a question: the best score of each parent, in falling order, numbered anew (ties: parent id)."""
    b = blocks.groupBy(question, "parent_id").agg(F.max("rerank_score").alias("rerank_score"))
    return b.withColumn("rank", F.row_number().over(Window.partitionBy(question).orderBy(F.desc("rerank_score"), "parent_id")))


def context_text(blocks: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, context): numbered blocks in order, blank lines between."""
    return blocks.groupBy(qid).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda b: F.concat(F.lit("【参考资料"), b["rank"].cast("string"), F.lit("】\n"), b["text"])), "\n\n").alias("context"))


def distinct_docs(fused: DataFrame, doc: str = "doc_id", qid: str = "qid") -> DataFrame:
    """Documents of each question in order of their first chunk: rows (qid, doc_id, doc_rank)."""
    d = fused.groupBy(qid, doc).agg(F.min("rank").alias("_r"))
    return d.select(qid, doc, F.row_number().over(Window.partitionBy(qid).orderBy("_r", doc)).alias("doc_rank"))


def recall_mrr(docs: DataFrame, support: DataFrame, k: int = 5, qid: str = "qid", doc: str = "doc_id") -> DataFrame:
    """Recall at k and reciprocal rank of each question over distinct documents: rows (qid, recall, mrr).

    ``support`` has (qid, doc_id), the wanted documents. Both are null for a question without any, 0
    where none is found.
    """
    n = support.groupBy(qid).agg(F.count_distinct(doc).alias("_n"))
    hit = docs.join(support.select(qid, doc).distinct(), [qid, doc]).groupBy(qid).agg(F.count_if(F.col("doc_rank") <= k).alias("_h"), F.min("doc_rank").alias("_first"))
    return n.join(hit, qid, "left").select(qid, (F.coalesce("_h", F.lit(0)) / F.col("_n")).alias("recall"), F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("mrr"))
