"""Models behind plain functions: retries, texts, embeddings, annotators and question writers."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.records import filled, verdicts_json
from tarn.operators import retrieval as R


class HttpError(Exception):
    """An answer of a service that is no success."""

    def __init__(self, status: int, body: str = ""):
        super().__init__(f"HTTP {status}: {body[:200]}")
        self.status = status


def transient(error: Exception) -> bool:
    """Whether trying again may help: timeouts, lost connections, status 429 and 500 or more. Other statuses never."""
    if isinstance(error, HttpError):
        return error.status == 429 or error.status >= 500
    return isinstance(error, (TimeoutError, ConnectionError))


def doubling(attempt: int) -> float:
    return 2.0**attempt


def linear(attempt: int) -> float:
    return 2.0 * (attempt + 1)


def with_retries(f: Callable, tries: int = 4, wait: float = 1.0, again: Callable[[Exception], bool] | tuple[type[Exception], ...] = transient, backoff: Callable[[int], float] = doubling) -> Callable:
    """``f`` tried again after errors that ``again`` lets pass, ``wait`` times ``backoff(attempt)`` seconds apart; other errors come through at once."""
    may = again if callable(again) and not isinstance(again, tuple) else lambda e: isinstance(e, again)

    def run(*a, **k):
        for i in range(tries):
            try:
                return f(*a, **k)
            except Exception as e:
                if i == tries - 1 or not may(e):
                    raise
                time.sleep(wait * backoff(i))

    return run


def model_udf(f: Callable[[list[str]], list[str]], batch: int = 10, fall_back: bool = False) -> Callable[[Column], Column]:
    """A text model as an Arrow function: texts in batches, blanks as one space; never repeated by the optimiser.

    With ``fall_back`` a batch for which the model raises gives its own texts back, as a rewriter should.
    """

    def run(texts: pd.Series) -> pd.Series:
        clean = [t if t and t.strip() else " " for t in texts]
        out: list[str] = []
        for i in range(0, len(clean), batch):
            part = clean[i : i + batch]
            try:
                out += f(part)
            except Exception:
                if not fall_back:
                    raise
                out += texts.iloc[i : i + batch].tolist()
        return pd.Series(out)

    return F.pandas_udf(run, T.StringType()).asNondeterministic()


@dataclass(frozen=True)
class Embedder:
    """A model of vectors: ``documents`` and ``queries`` take a list of texts and give a vector (or None) for each, which may differ by mode."""

    documents: Callable[[list[str]], Sequence]
    queries: Callable[[list[str]], Sequence]
    dim: int
    batch: int = 10

    def of(self, df: DataFrame, key: str, text: str, mode: str = "documents") -> DataFrame:
        """(key, embedding) of every row: blanks go as one space, missing vectors come as zeros, another dimension is an error."""
        f, dim = (self.documents if mode == "documents" else self.queries), self.dim

        def vectors(texts: list[str]) -> list:
            got = list(f([t if t.strip() else " " for t in texts]))
            got += [None] * (len(texts) - len(got))
            rows = [np.zeros(dim) if v is None else np.asarray(v, dtype=np.float64) for v in got]
            if any(len(v) != dim for v in rows):
                raise ValueError(f"a vector has not the dimension {dim}")
            return rows

        return R.embed(df, key, text, vectors, self.batch)


def _bare_histogram(texts: list[str]) -> list:
    return list(R.histogram_of(["" if t == " " else t for t in texts]))


#: The deterministic embedder of the tests.
HISTOGRAM = Embedder(_bare_histogram, _bare_histogram, R.DIM, 1024)


def json_object(c: Column) -> Column:
    """The widest object of a free text, without code fences; null if there is none."""
    t = F.regexp_extract(F.regexp_replace(c, r"(?m)^\s*```[a-z]*\s*|\s*```\s*$", ""), r"(?s)(\{.*\})", 1)
    return F.when(t != "", t)


def annotate(rows: DataFrame, template: str, fields: Sequence[str], criteria: list[str], model: Callable[[Column], Column]) -> DataFrame:
    """A second annotator: one call for all criteria of a row, once more where the answer is no full set of verdicts.

    Adds ``verdicts`` (criterion -> verdict, evidence, reason; null after two failures) and ``error``. The answers are
    written once, so that no model is asked again by a later plan.
    """
    from tarn.storage import Scratch

    scratch = Scratch(rows.sparkSession, "annotate")
    first = scratch.cut(rows.withColumn("_prompt", filled(template, *fields)).withColumn("_t", model(F.col("_prompt"))), "first")
    bad = verdicts_json(F.col("_t"), criteria).isNull()
    both = first.where(~bad).unionByName(first.where(bad).withColumn("_t", model(F.col("_prompt"))))
    out = scratch.cut(both, "answers").withColumn("verdicts", verdicts_json(F.col("_t"), criteria))
    return out.withColumn("error", F.when(F.col("verdicts").isNull(), F.concat(F.lit("no verdicts: "), F.substring(F.coalesce("_t", F.lit("")), 1, 200)))).drop("_prompt", "_t")


def draft_questions(passages: DataFrame, templates: dict[str, str], model: Callable[[Column], Column], by: str = "type") -> DataFrame:
    """Questions that a model writes for passages (type, doc_ids, passage): question, ground_truth, key_claims, difficulty beside the columns given.

    ``templates`` has a prompt for each type with ``{passage}``. Answers that are no object, have no question or ask to be
    skipped are left out.
    """
    prompt = F.lit(None).cast("string")
    for kind, template in templates.items():
        prompt = F.when(F.col(by) == kind, filled(template, "passage")).otherwise(prompt)
    got = passages.withColumn("_j", json_object(model(prompt)))
    r = F.from_json("_j", "question string, ground_truth string, key_claims array<string>, difficulty string, skip boolean")
    got = got.withColumn("_r", r).where(~F.coalesce(F.col("_r.skip"), F.lit(False)) & (F.trim(F.coalesce("_r.question", F.lit(""))) != ""))
    return got.select(*passages.columns, F.trim("_r.question").alias("question"), F.trim("_r.ground_truth").alias("ground_truth"), F.filter(F.coalesce("_r.key_claims", F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")) != "").alias("key_claims"), F.col("_r.difficulty").alias("difficulty"))


def verify_questions(items: DataFrame, template: str, model: Callable[[Column], Column]) -> DataFrame:
    """Adds ``verified`` and ``reason``: whether a model finds a question answerable, traceable and unambiguous.

    Out-of-scope questions need no check. An answer that cannot be read is a failure with the reason given.
    """
    scope = F.coalesce(F.col("type") == "out_of_scope", F.lit(False))
    fields = items.withColumn("claims", F.array_join(F.coalesce("key_claims", F.array().cast("array<string>")), "；"))
    r = F.from_json(json_object(model(F.when(~scope, filled(template, "question", "ground_truth", "claims", "passage")))), "answerable boolean, traceable boolean, unambiguous boolean, reason string")
    got = fields.withColumn("_r", r)
    ok = F.coalesce(F.col("_r.answerable") & F.col("_r.traceable") & F.col("_r.unambiguous"), F.lit(False))
    return got.select(*items.columns, (scope | ok).alias("verified"), F.when(scope, "out of scope").when(F.col("_r").isNull(), "no answer that can be read").otherwise(F.coalesce("_r.reason", F.lit(""))).alias("reason"))


def tool(name: str, text: str, **parameters: str) -> dict:
    """A search tool as models take it: a name, what it is for, and its text parameters, all required."""
    if not re.fullmatch(r"[a-z_][a-z0-9_]*", name):
        raise ValueError(f"not a tool's name: {name}")
    fields = {k: {"type": "string", "description": v} for k, v in parameters.items()}
    return {"type": "function", "function": {"name": name, "description": text, "parameters": {"type": "object", "properties": fields, "required": list(fields)}}}


def tools_json(*tools: dict) -> str:
    return json.dumps(list(tools), ensure_ascii=False, sort_keys=True)


def planned_queries(questions: DataFrame, plan: Callable[[str], Sequence[str]], most: int = 4) -> DataFrame:
    """Search queries that a planner makes of each question (qid, question): rows (question_id, ord, query), at most ``most``.

    Without a usable query, or where the planner raises, the question itself is the one query.
    """

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> list[str]:
            try:
                got = [q.strip() for q in plan(t) if q and q.strip()][:most]
            except Exception:  # noqa: BLE001
                got = []
            return got or [t]

        return texts.map(lambda t: one(t or ""))

    return questions.select(F.col("qid").alias("question_id"), F.posexplode(run.asNondeterministic()(F.col("question"))).alias("ord", "query"))
