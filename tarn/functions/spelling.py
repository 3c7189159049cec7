"""Uniform spellings of categories, splits and document ids, as column expressions and, for tests, as SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chinese names of item types and difficulties (fixed values).
TYPE_NAMES = {"事实": "factual", "多跳": "multi_hop", "口语": "colloquial", "库外": "out_of_scope", "对抗": "adversarial"}
DIFFICULTY_NAMES = {"简单": "easy", "中等": "medium", "困难": "hard"}
SENTINEL = "库外语料"

FULL = "".join(chr(0xFF01 + i) for i in range(94))
HALF = "".join(chr(0x21 + i) for i in range(94))
_EDGE = r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$"


def half_width(c: Column) -> Column:
    """Full-width letters, digits and marks as their ASCII counterparts."""
    return F.translate(c, FULL, HALF)


def trimmed(c: Column) -> Column:
    """Without blanks and invisible characters at either end; null when nothing is left."""
    t = F.regexp_replace(c, _EDGE, "")
    return F.when(t != "", t)


def word(c: Column, names: dict[str, str] | None = None) -> Column:
    """A category in its plain spelling: lower case, underscores, Chinese names translated."""
    t = F.regexp_replace(F.lower(trimmed(half_width(c))), r"[\s\-_]+", "_")
    if names:
        t = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), t), t)
    return t


def split_name(c: Column) -> Column:
    """A split in its plain spelling, without separators (``hold-out`` is ``holdout``)."""
    t = F.regexp_replace(F.lower(half_width(c)), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "")
    return F.when(t != "", t)


def document_id(c: Column) -> Column:
    """A document id in its plain spelling, in lower case; null for the out-of-scope sentinel and for blanks. Folder and file ending are taken off."""
    t = F.lower(trimmed(half_width(c)))
    t = F.regexp_replace(t, r"^.*[/\\]", "")
    t = F.regexp_replace(t, r"\.(txt|pdf|md|json|html?)$", "")
    t = F.regexp_replace(t, r"[\s\-]+", "_")
    return F.when((t != "") & ~t.contains(SENTINEL), t)


def _half_sql(c: str) -> str:
    quoted = HALF.replace("'", "''")
    return f"translate({c}, '{FULL}', '{quoted}')"


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\p{{Z}}\\p{{Cf}}]+|[\\s\\p{{Z}}\\p{{Cf}}]+$', '', 'g')"


def word_sql(c: str, names: dict[str, str] | None = None) -> str:
    """``word`` in SQL as DuckDB runs it."""
    t = f"regexp_replace(lower({trim_sql(_half_sql(c))}), '[\\s\\-_]+', '_', 'g')"
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (names or {}).items())
    return f"CASE {t} WHEN '' THEN NULL {whens} ELSE {t} END"


def split_sql(c: str) -> str:
    """``split_name`` in SQL as DuckDB runs it."""
    return f"nullif(regexp_replace(lower({_half_sql(c)}), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '', 'g'), '')"


def document_sql(c: str) -> str:
    """``document_id`` in SQL as DuckDB runs it."""
    t = f"lower({trim_sql(_half_sql(c))})"
    t = f"regexp_replace(regexp_replace(regexp_replace({t}, '^.*[/\\\\]', ''), '\\.(txt|pdf|md|json|html?)$', ''), '[\\s\\-]+', '_', 'g')"
    return f"CASE WHEN {t} <> '' AND NOT contains({t}, '{SENTINEL}') THEN {t} END"
