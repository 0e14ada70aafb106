"""Two-sided p-values of a correlation, for a handful of result rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def two_sided_p(r: float, n: int) -> float | None:
    """P(|correlation| >= |r|) under no association, from t with n - 2 degrees of freedom."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return None
    if n == 2 or abs(r) >= 1:
        return 0.0
    return _beta_tail((n - 2) / 2, 0.5, 1 - r * r)


def p_value(r: str | Column, n: str | Column) -> Column:
    @F.pandas_udf("double")
    def tail(r_values: pd.Series, n_values: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(r) else two_sided_p(float(r), int(n)) for r, n in zip(r_values, n_values)], dtype="float64")

    return tail(r, n)
