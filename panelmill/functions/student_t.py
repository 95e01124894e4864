"""Two-sided p-value of a Student t statistic, as an Arrow-batched UDF.

Spark has no t distribution. The inputs are one row per group and window, so
this runs on a handful of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float, rounds: int = 500, eps: float = 1e-16) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, rounds + 1):
        for coef in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + coef * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + coef / c
            c = c if abs(c) > _TINY else _TINY
            h *= c * d
        if abs(c * d - 1.0) < eps:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(min(max(x, 0.0), 1.0))
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def _two_sided_batch(t: pd.Series, df: pd.Series) -> pd.Series:
    values = [
        two_sided(a, b) if np.isfinite(a) and b > 0 else None
        for a, b in zip(t.to_numpy(float), df.to_numpy(float))
    ]
    return pd.Series(values, dtype="float64")


def t_p_value(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) with df degrees of freedom; null where t is null."""
    return _two_sided_batch(t.cast("double"), df.cast("double"))
