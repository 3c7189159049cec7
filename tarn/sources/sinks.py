"""Sinks: snapshots, records, caches, report tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, whole or not at all: written beside it, then renamed over it."""
    fs, jvm = _fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    # one rename that replaces the target: a reader sees the old file or the new one, and a crash leaves the old one
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    qualified = [fs.makeQualified(p) for p in (tmp, jvm.org.apache.hadoop.fs.Path(path))]
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified[0].toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(*qualified, overwrite)


def write_snapshot(tables: dict[str, DataFrame], root: str) -> str:
    """All tables of an index as one version; the pointer moves only when every table is there."""
    spark = next(iter(tables.values())).sparkSession
    version = f"{root.rstrip('/')}/v-{uuid.uuid4().hex[:12]}"
    for name, df in tables.items():
        df.write.parquet(f"{version}/{name}")
    write_text(spark, f"{root.rstrip('/')}/CURRENT", version)
    return version


def read_snapshot(spark: SparkSession, root: str, dim: int | None = None) -> dict[str, DataFrame]:
    """Tables of the current version; refused if children and vectors are not the same rows or the dimension differs."""
    version = spark.read.text(f"{root.rstrip('/')}/CURRENT").first().value
    fs, jvm = _fs(spark, version)
    names = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(version))]
    t = {n: spark.read.parquet(f"{version}/{n}") for n in names}
    if {"children", "vectors"} <= set(t):
        a, b = t["children"].select("chunk_uid"), t["vectors"].select("chunk_uid")
        if a.count() != b.count() or not a.join(b, "chunk_uid", "left_anti").isEmpty():
            raise ValueError("children and vectors of the index are not the same rows")
        found = [r[0] for r in t["vectors"].select(F.size("embedding")).distinct().limit(2).collect()]
        if len(found) > 1 or (dim is not None and found and found[0] != dim):
            raise ValueError(f"vectors have dimension {found}, expected {dim}")
    return t


def append_jsonl(df: DataFrame, path: str, keep_nulls: bool = False) -> None:
    """Records appended as JSON lines; absent fields are left out unless they are kept."""
    df.write.mode("append").option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def write_form(df: DataFrame, path: str) -> None:
    """A CSV for people, with header and byte order mark, in one file (forms are small by nature)."""
    first = df.columns[0]
    df.coalesce(1).withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)


def merge_form(rows: DataFrame, form: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows with the filled-in fields of a form where it has any."""
    f = form.select(*keys, *[F.when(F.trim(c) != "", F.trim(c)).alias(f"_{c}") for c in fields])
    return rows.join(f, keys, "left").select(*[c for c in rows.columns if c not in fields], *[F.coalesce(F.col(f"_{c}"), F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in fields])


def run_report(run_id: str, summary: dict, types: list[dict], coverage: dict | None = None, aborted: bool = False) -> str:
    """A run's report as Markdown, from its aggregated row, its rows by type and its judge coverage.

    ``summary`` is a row of ``evaluation.summarise``, ``types`` are rows of ``evaluation.by_type``, ``coverage``
    one of ``evaluation.judge_coverage``. Rates come with their interval; what does not apply is a dash.
    """
    show = lambda v, n=3: "—" if v is None else f"{v:.{n}f}"
    out = [f"# 评测报告 · {run_id}", "", f"{summary['n']} 题" + ("，因成本护栏提前结束" if aborted else ""), "", "## 指标", "", "| 指标 | 值 | 95 % 区间 | n |", "|---|---:|---|---:|"]
    for name in ("refused", "false_refusal", "oos_refusal_pass"):
        if summary.get(f"{name}_n"):
            out.append(f"| {name} | {show(summary[name])} | {show(summary[name + '_lo'])}–{show(summary[name + '_hi'])} | {summary[name + '_n']} |")
    for name in ("recall5", "mrr"):
        out.append(f"| {name} | {show(summary.get(name))} | — | — |")
    out += ["", "## 题型", "", "| 题型 | n | 拒答 | 规则通过 |", "|---|---:|---:|---:|"]
    for t in sorted(types, key=lambda t: t["type"]):
        rules = f"{t['metric_pass']}/{t['metric_total']}" if t["metric_total"] else "—"
        out.append(f"| {t['type']} | {t['n']} | {t['refused']} | {rules} |")
    if coverage:
        out += ["", "## 判定覆盖", "", f"应判 {coverage['expected']}，有效 {coverage['valid']}，覆盖率 {show(coverage['coverage'])}"]
    out += ["", "## 成本与延迟", "", f"合计 {show(summary.get('cost'), 4)}，每题 {show(summary.get('cost_per_item'), 5)}；p50 {show(summary.get('p50_ms'), 0)} ms，p95 {show(summary.get('p95_ms'), 0)} ms"]
    return "\n".join(out) + "\n"


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table; a number under 1 has four digits, others are grouped with two, none is a dash."""

    def show(v) -> str:
        if v is None:
            return "—"
        if isinstance(v, float):
            return f"{v:.4f}" if abs(v) < 1 else f"{v:,.2f}"
        return f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)

    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has at most {most} rows")
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])
