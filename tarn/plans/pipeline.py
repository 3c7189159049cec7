"""The facade: an index of chunk tables, whole sets of questions at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.text import excerpt
from tarn.operators import retrieval as R
from tarn.operators.chunking import children_of, chunk, parents_of
from tarn.operators.citations import citation_stats, citations, with_sources
from tarn.operators.order import positions
from tarn.plans.models import HISTOGRAM, Embedder, model_udf, with_retries  # noqa: F401
from tarn.sources.sinks import read_snapshot, write_snapshot
from tarn.storage import Scratch


@dataclass(frozen=True)
class Settings:
    """Settings of retrieval; ``name`` tells runs apart."""

    parent: tuple[int, int] = (1200, 150)
    child: tuple[int, int] = (400, 40)
    vector_k: int = 24
    keyword_k: int = 24
    keyword: bool = True
    fusion: str = "rrf"
    rrf_k: int = 60
    rerank_top: int = 12
    rerank: bool = True
    base_k: int = 4
    max_k: int = 8
    hyde: bool = False

    @property
    def name(self) -> str:
        return f"vec{self.vector_k}_bm25{self.keyword_k}_{self.fusion}{self.rrf_k}_rr{self.rerank_top}_k{self.base_k}-{self.max_k}_hyde{int(self.hyde)}_rr{int(self.rerank)}bm{int(self.keyword)}"

    def but(self, **changes) -> Settings:
        return replace(self, **changes)


class Index:
    """Tables of one corpus: children (in corpus order), parents, vectors, tokens, terms, documents."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], settings: Settings | None = None, embedder: Embedder = HISTOGRAM):
        self.spark, self.tables, self.settings, self.embedder = spark, tables, settings or Settings(), embedder
        self._keywords: R.Keywords | None = None

    @classmethod
    def build(cls, pages: DataFrame, root: str, settings: Settings | None = None, embedder: Embedder = HISTOGRAM) -> Index:
        """Chunk pages and write one snapshot of the index, vectors and tokens with it; every table is there or none.

        ``pages`` has doc_id, page, text and, if known, ``doc_ord`` (the order in which documents
        came in, which settles ties in search; else the order of their ids) and ``loaded_at``.
        """
        s = settings or Settings()
        with Scratch(pages.sparkSession, "index") as scratch:
            c = scratch.cut(chunk(pages, s.parent, s.child), "chunks")
            given = lambda name, else_: F.min(name) if name in pages.columns else F.lit(else_)
            documents = pages.groupBy("doc_id").agg(given("doc_ord", 0).alias("doc_ord"), (F.max(F.col("loaded_at").cast("string")) if "loaded_at" in pages.columns else F.lit("")).alias("loaded_at"))
            kids = children_of(c).join(documents.select("doc_id", "doc_ord"), "doc_id")
            kids = scratch.cut(positions(kids, ["doc_ord", "doc_id", "ord"], "row_id", scratch).drop("doc_ord"), "children")
            words = R.Keywords.of(kids.select("row_id", "text"), scratch)
            vectors = embedder.of(kids, "chunk_uid", "text")
            write_snapshot({"children": kids, "parents": parents_of(c), "vectors": vectors, "tokens": words.tokens, "terms": words.terms, "documents": documents}, root)
        return cls.load(pages.sparkSession, root, s, embedder)

    @classmethod
    def load(cls, spark: SparkSession, root: str, settings: Settings | None = None, embedder: Embedder = HISTOGRAM) -> Index:
        return cls(spark, read_snapshot(spark, root, embedder.dim), settings, embedder)

    @property
    def keywords(self) -> R.Keywords:
        if self._keywords is None:
            self._keywords = R.Keywords(self.tables["tokens"], self.tables["terms"])
        return self._keywords

    def retrieve(self, questions: DataFrame, settings: Settings | None = None, rewrite: Callable[[Column], Column] | None = None, reranker: Callable | None = None) -> DataFrame:
        """Context blocks of every question (qid, question): rows (qid, rank, parent_id, doc_id, text, rerank_score).

        With ``rewrite`` a hypothetical answer stands for the question in search, rerank and the length rule; it is
        used only where it is longer than ten characters. With ``reranker`` (``retrieval.rerank_with``) a model ranks
        each pool; where it fails the fused order stays.
        """
        s = settings or self.settings
        q = questions.select("qid", F.col("question").alias("text"))
        if rewrite is not None:
            r = rewrite(F.col("text"))
            q = q.withColumn("text", F.when(F.length(r) > 10, r).otherwise(F.col("text")))
        kids = self.tables["children"]
        v = R.nearest(self.embedder.of(q, "qid", "text", "queries"), kids.select("chunk_uid", "row_id").join(self.tables["vectors"], "chunk_uid"), s.vector_k)
        k = R.bm25(q, self.keywords, s.keyword_k) if s.keyword else v.limit(0)
        pool = R.fuse(v, k, s.fusion, s.rrf_k).join(kids.select("row_id", "chunk_uid", "parent_id", "text"), "row_id").join(q.select("qid", F.col("text").alias("query")), "qid")
        if s.rerank and reranker is not None:
            ranked = R.rerank_with(pool, reranker, s.rerank_top).drop("error")
        else:
            ranked = R.rerank(pool, s.rerank_top, score=R.overlap_score(F.col("query"), F.col("text")) if s.rerank else None)
        return R.context_blocks(ranked, self.tables["parents"], R.context_size(ranked, s.base_k, s.max_k))

    def retrieve_many(self, questions: DataFrame, queries: DataFrame, most: int = 4, settings: Settings | None = None) -> DataFrame:
        """Blocks of questions that several search queries stand for: rows (question_id, rank, parent_id, doc_id, text, rerank_score).

        ``queries`` has question_id, ord and query, at most ``most`` of a question count. Each is retrieved on its own; a parent
        keeps its best score, and the number of blocks follows the original question. A question with one query has that query's blocks.
        """
        s = settings or self.settings
        q = queries.where(F.col("ord") < most).select("question_id", F.struct("question_id", "ord").alias("qid"), F.col("query").alias("question"))
        b = self.retrieve(q.select("qid", "question"), s).withColumn("question_id", F.col("qid.question_id"))
        m = R.merge_blocks(b)
        size = R.context_size(m.join(questions.select(F.col("qid").alias("question_id"), F.col("question").alias("query")), "question_id"), s.base_k, s.max_k, qid="question_id")
        one = q.groupBy("question_id").agg(F.count("*").alias("_n"))
        got = m.join(size, "question_id").join(one, "question_id").where("rank <= take or _n = 1").select("question_id", "rank", "parent_id", "rerank_score")
        return got.join(self.tables["parents"].select("parent_id", "doc_id", "text"), "parent_id").select("question_id", "rank", "parent_id", "doc_id", "text", "rerank_score")

    def answer(self, questions: DataFrame, generate: Callable[[Column, Column], Column], settings: Settings | None = None) -> DataFrame:
        """(qid, question, context, answer, citation counts): ``generate`` makes an answer of question and context."""
        b = self.retrieve(questions, settings)
        ctx = R.context_text(b).join(b.groupBy("qid").agg(F.count("*").alias("n_contexts")), "qid")
        a = questions.join(ctx, "qid", "left").withColumn("answer", generate(F.col("question"), F.col("context")))
        return a.join(citation_stats(a, "qid", "answer", F.coalesce("n_contexts", F.lit(0))), "qid")

    def cited(self, answers: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
        """Citations of answers, with document, parent and snippet where the blocks that were given are known."""
        c = citations(answers, "qid", "answer", F.coalesce("n_contexts", F.lit(0)))
        return c if blocks is None else with_sources(c, blocks, "qid")

    def documents(self) -> DataFrame:
        """Documents with their children, those loaded last first (compared as text, a missing time last)."""
        n = self.tables["children"].groupBy("doc_id").agg(F.count("*").alias("children"), F.sum(F.length("text")).alias("chars"))
        d = self.tables["documents"].select("doc_id", F.coalesce("loaded_at", F.lit("")).alias("loaded_at"))
        return n.join(d, "doc_id").orderBy(F.desc("loaded_at"), "doc_id")

    def content(self, doc_id: str) -> DataFrame:
        """Parents of a document in order, long ones as excerpts."""
        p = self.tables["parents"].where(F.col("doc_id") == doc_id)
        return p.orderBy("ord").select("parent_id", excerpt(F.col("text")).alias("text"))


def judge_pending(rows: DataFrame, cache: DataFrame, key: Column, judge: Callable[[Column], Column], prompt: Column) -> tuple[DataFrame, DataFrame]:
    """Verdicts of rows, the judge asked only for what the cache (key, value, created_at) lacks; and the cache with what is new.

    ``judge`` makes free text of a prompt; text without a decided verdict and evidence is asked about once more, then left null.
    """
    from tarn.functions.records import verdict_json
    from tarn.operators.curation import upsert

    spark = rows.sparkSession
    scratch = Scratch(spark, "judge")
    r = scratch.cut(rows.withColumn("key", key).withColumn("_prompt", prompt), "rows")
    new = r.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"]).select("key", "_prompt")
    asked = scratch.cut(new.withColumn("_t", judge(F.col("_prompt"))), "asked")
    bad = asked.where(verdict_json(F.col("_t")).isNull())
    again = bad.select("key", judge(F.concat("_prompt", F.lit("\n只输出一个 JSON 对象。"))).alias("_t"))
    got = scratch.cut(asked.where(verdict_json(F.col("_t")).isNotNull()).select("key", "_t").unionByName(again), "answers")
    made = got.where(verdict_json(F.col("_t")).isNotNull()).select("key", F.to_json(verdict_json(F.col("_t"))).alias("value"), F.current_timestamp().alias("created_at"))
    full = scratch.cut(upsert(cache.select("key", "value", "created_at"), made, ["key"], "created_at"), "cache")
    out = r.drop("_prompt").join(full.select("key", F.from_json("value", "verdict string, evidence string, reason string").alias("judged")), "key", "left")
    return out, full


def prompts(folder: str) -> dict[str, str]:
    """Prompt texts by version: the Markdown files of a folder, by their names."""
    from pathlib import Path

    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(folder).glob("*.md"))}


def load_settings(path: str) -> Settings:
    """Settings of a JSON file, or a YAML file where a reader is installed; defaults for what it lacks or if it is missing."""
    import json
    from pathlib import Path

    p = Path(path)
    if not p.is_file():
        return Settings()
    if p.suffix == ".json":
        found = json.loads(p.read_text(encoding="utf-8"))
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML settings needs the yaml package") from e
        found = yaml.safe_load(p.read_text(encoding="utf-8")) or {}
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in Settings.__dataclass_fields__}
    return Settings(**known)
