"""Uniform spellings of the item tables, as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.spelling import DIFFICULTY_NAMES, SENTINEL, TYPE_NAMES, document_id, half_width, split_name, trimmed, word  # noqa: F401


def once(df: DataFrame, key: str, *columns: str, latest: str | None = None) -> DataFrame:
    """One row for each key: the one delivered last (ties: the greatest row), so repeats count once.

    Rows with a null key are left out. The aggregate is partial before the
    shuffle, so that a key with a third of all rows costs no more than others.
    """
    order = [F.col(latest)] if latest and latest in df.columns else []
    row = F.struct(*columns)
    pick = F.max_by(row, F.struct(*order, F.xxhash64(*columns))) if order else F.max_by(row, F.xxhash64(*columns))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(pick.alias("_r")).select(key, "_r.*")
