"""Records of models: templates, JSON in free text, keys, usage and cost."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fill(template: str, fields: dict[str, str]) -> str:
    """A template with ``{name}`` (lower case) replaced once: what a field brings in is never filled again. A missing field is an error; other braces stay."""

    def value(m: re.Match) -> str:
        if m.group(1) not in fields:
            raise KeyError(f"template field {m.group(1)} is missing")
        return str(fields[m.group(1)])

    return re.sub(r"\{([a-z_][a-z0-9_]*)\}", value, template)


def filled(template: str, *names: str) -> Column:
    """``fill`` over columns, batch by batch."""

    @F.pandas_udf(T.StringType())
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([fill(template, dict(zip(names, row, strict=True))) for row in zip(*cols, strict=True)])

    return run(*[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])


def balanced(text: str) -> str | None:
    """The first object in a text, from any opening brace on, that is whole JSON and has a verdict."""
    read = json.JSONDecoder().raw_decode
    at = text.find("{")
    while at >= 0:
        try:
            found, end = read(text, at)
            if "verdict" in found:
                return text[at:end]
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def _balanced(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: balanced(t) if t else None)


VERDICT = "verdict string, evidence string, reason string"


def verdict_json(c: Column) -> Column:
    """(verdict, evidence, reason) of a judge's free text: the widest object if it parses, else the first balanced one; null if neither."""
    text = F.regexp_replace(c, r"(?m)^```[a-z]*\s*$", "")
    wide = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    # only what the wide object does not settle goes to Python
    ok = F.get_json_object(wide, "$.verdict").isNotNull() & F.from_json(wide, VERDICT).isNotNull()
    r = F.from_json(F.when(ok, wide).otherwise(_balanced(F.when(~F.coalesce(ok, F.lit(False)), text))), VERDICT)
    v = F.lower(F.trim(r["verdict"]))
    good = v.isin("pass", "fail") & (F.coalesce(F.trim(r["evidence"]), F.lit("")) != "")
    return F.when(good, F.struct(v.alias("verdict"), F.substring(r["evidence"], 1, 300).alias("evidence"), F.substring(r["reason"], 1, 300).alias("reason")))


def verdicts_json(c: Column, criteria: list[str]) -> Column:
    """criterion -> (verdict, evidence, reason) of an annotator's one object for all criteria, fences allowed.

    Null unless each criterion has an object with a decided verdict; evidence and reason are cut to 300 characters, absent ones are empty.
    """
    wide = F.regexp_extract(F.regexp_replace(c, r"(?m)^\s*```[a-z]*\s*|\s*```\s*$", ""), r"(?s)(\{.*\})", 1)
    got = F.from_json(wide, "map<string,string>")
    one = {k: F.from_json(F.element_at(got, k), VERDICT) for k in criteria}
    decided = F.lit(True)
    for r in one.values():
        decided = decided & F.coalesce(F.lower(F.trim(r["verdict"])).isin("pass", "fail"), F.lit(False))
    cut = lambda x: F.substring(F.coalesce(x, F.lit("")), 1, 300)
    made = F.create_map(*[x for k, r in one.items() for x in (F.lit(k), F.struct(F.lower(F.trim(r["verdict"])).alias("verdict"), cut(r["evidence"]).alias("evidence"), cut(r["reason"]).alias("reason")))])
    return F.when(decided, made)


def cache_key(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON with sorted names; long texts go in as their own hash."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(fields[k].cast("string"), F.lit("")).alias(k) for k in sorted(fields)])), 256)


def tool_queries(calls: Column, most: int = 4) -> Column:
    """Queries of search calls (name, JSON arguments): broken JSON and nameless calls are dropped, at most ``most`` kept."""
    q = F.transform(F.filter(calls, lambda c: (F.coalesce(c["name"], F.lit("")) == "search_documents") & F.get_json_object(c["arguments"], "$.query").isNotNull()), lambda c: F.trim(F.get_json_object(c["arguments"], "$.query")))
    return F.slice(F.filter(q, lambda x: x != ""), 1, most)


def numbered_context(texts: Column, sources: Column) -> Column:
    """``[i]（source）`` and text of each context, blank lines between; no brackets where a source is missing."""
    s = F.coalesce(sources, F.array().cast("array<string>"))
    part = F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"), F.when(F.coalesce(F.get(s, i), F.lit("")) != "", F.concat(F.lit("（"), F.get(s, i), F.lit("）"))).otherwise(""), F.lit("\n"), t))
    return F.array_join(part, "\n\n")


def busy(ts: Column) -> Column:
    """Monday to Friday, 9 to 12 and 14 to 18."""
    return (F.weekday(ts) < 5) & (F.hour(ts).between(9, 11) | F.hour(ts).between(14, 17))


def cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """``usage`` (model, at, prompt_tokens, cache_hit_tokens, completion_tokens) with its cost by ``rates``.

    ``rates`` has model, busy, input, cache_hit and output per million tokens, ``_default`` for models it
    does not name; a null cache rate is the input rate. A rate table is a row for each model.
    """
    u = usage.withColumn("busy", busy(F.col("at")))
    r = rates.select("busy", F.col("model").alias("_m"), F.struct("input", F.coalesce("cache_hit", "input").alias("hit"), "output").alias("_r"))
    own = u.join(F.broadcast(r.withColumnRenamed("_m", "model")), ["model", "busy"], "left")
    d = r.where("_m = '_default'").select("busy", F.col("_r").alias("_d"))
    own = own.join(F.broadcast(d), "busy", "left").withColumn("_r", F.coalesce("_r", "_d"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = (n("prompt_tokens") - n("cache_hit_tokens")) * F.col("_r.input") + n("cache_hit_tokens") * F.col("_r.hit") + n("completion_tokens") * F.col("_r.output")
    return own.withColumn("cost", F.round(total / 1_000_000, 6)).drop("_r", "_d")


def stage_costs(traces: DataFrame, rates: DataFrame, rerank_rate: float) -> DataFrame:
    """Costs of a trace by stage, and their sum: rows (trace_id, hyde, rerank, generation, total), each rounded to six digits.

    ``traces`` has trace_id, stage (hyde, rerank or generation), model, at, prompt_tokens, cache_hit_tokens,
    completion_tokens and total_tokens. Rerank costs its total tokens at ``rerank_rate`` per million, the
    others by ``rates`` (``cost``); a stage that is absent costs nothing.
    """
    c = cost(traces, rates)
    own = F.when(F.col("stage") == "rerank", F.coalesce("total_tokens", F.lit(0)) * rerank_rate / 1_000_000).otherwise(F.coalesce("cost", F.lit(0.0)))
    each = [F.round(F.sum(F.when(F.col("stage") == s, own).otherwise(0.0)), 6).alias(s) for s in ("hyde", "rerank", "generation")]
    out = c.groupBy("trace_id").agg(*each)
    return out.withColumn("total", F.round(F.col("hyde") + F.col("rerank") + F.col("generation"), 6))


def usage_sum(df: DataFrame, by: list[str], usage: str = "usage") -> DataFrame:
    """Field-wise sums of a usage struct; all fields empty gives null."""
    fields = [f.name for f in df.schema[usage].dataType.fields if isinstance(f.dataType, T.NumericType)]
    s = df.groupBy(*by).agg(*[F.sum(F.col(usage)[f]).alias(f) for f in fields])
    return s.select(*by, F.when(F.coalesce(*fields).isNotNull(), F.struct(*fields)).alias(usage))


def usage_of(raw: Column) -> Column:
    """Usage as a struct of five counts, from a model's own JSON; absent counts are null."""
    g = lambda p: F.get_json_object(raw, p).cast("long")
    return F.struct(
        g("$.prompt_tokens").alias("prompt_tokens"),
        g("$.completion_tokens").alias("completion_tokens"),
        g("$.total_tokens").alias("total_tokens"),
        g("$.completion_tokens_details.reasoning_tokens").alias("reasoning_tokens"),
        F.coalesce(g("$.prompt_cache_hit_tokens"), g("$.prompt_tokens_details.cached_tokens")).alias("cache_hit_tokens"),
    )


def trace_id(at: Column) -> Column:
    """``t``, the time to the second, a dash and six hex digits."""
    return F.concat(F.lit("t"), F.date_format(at, "yyyyMMddHHmmss"), F.lit("-"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 6))
