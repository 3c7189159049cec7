"""Statistics over counts, as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: 0.975 quantile of the normal distribution (fixed value).
Z = 1.959963984540054


def rate(k: Column, n: Column) -> Column:
    """k / n; 0 where n is 0."""
    return F.when(n > 0, k / n).otherwise(F.lit(0.0))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Ends of the 95 % Wilson interval, within 0 and 1, to 4 digits; (0, 1) where n is 0."""
    p, z2 = k / n, Z * Z
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    lo = F.when(n > 0, F.round(F.greatest(F.lit(0.0), mid - half), 4)).otherwise(F.lit(0.0))
    hi = F.when(n > 0, F.round(F.least(F.lit(1.0), mid + half), 4)).otherwise(F.lit(1.0))
    return lo, hi


def mcnemar(b: Column, c: Column) -> Column:
    """Chi-squared with continuity correction, to 4 digits; not clamped, so that b = c = 1 gives 0.5."""
    d = F.abs(b - c) - 1
    return F.when(b + c > 0, F.round(d * d / (b + c), 4)).otherwise(F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def chi2_p(chi2: pd.Series) -> pd.Series:
    """The p value of chi-squared with one degree of freedom."""
    return chi2.map(lambda x: None if x is None or x != x else math.erfc(math.sqrt(max(x, 0.0) / 2)))


def kappa(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Cohen's kappa of two raters: both positive, first only, second only, both negative; null without rows or chance of disagreement."""
    n = a + b + c + d
    agree = F.try_divide(a + d, n)
    chance = F.try_divide((a + b) * (a + c) + (c + d) * (b + d), n * n)
    return F.when((n > 0) & (chance < 1), (agree - chance) / (1 - chance))


def percentile(c: Column, q: float) -> Column:
    """Linear interpolation at (n - 1) q; 0 without rows."""
    return F.coalesce(F.percentile(c, F.lit(q)), F.lit(0.0))
