"""Tail probabilities for small result tables, as vectorised column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: series below a+1, continued fraction above."""
    if not (a > 0 and x >= 0):
        return float("nan")
    if x == 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * front)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by continued fraction."""
    if x <= 0 or x >= 1 or not (a > 0 and b > 0):
        return float("nan") if x != x else (0.0 if x <= 0 else 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_i(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def _each(fn):
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([fn(*v) if all(x is not None and x == x for x in v) else np.nan for v in zip(*cols, strict=True)], dtype="float64")

    return run


def chi2_sf(x: Column, df: Column) -> Column:
    def run(x: pd.Series, k: pd.Series) -> pd.Series:
        return _each(lambda v, d: _gamma_q(d / 2, max(v, 0.0) / 2))(x, k)

    return F.pandas_udf(run, "double")(x.cast("double"), df.cast("double"))


def f_sf(x: Column, d1: Column, d2: Column) -> Column:
    def run(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return _each(lambda v, p, q: 1.0 if v <= 0 else _beta_i(q / 2, p / 2, q / (q + p * v)))(x, a, b)

    return F.pandas_udf(run, "double")(x.cast("double"), d1.cast("double"), d2.cast("double"))


def t_two_sided(t: Column, df: Column) -> Column:
    return f_sf(t * t, F.lit(1.0), df)


def normal_two_sided(z: Column) -> Column:
    def run(z: pd.Series) -> pd.Series:
        return _each(lambda v: math.erfc(abs(v) / math.sqrt(2)))(z)

    return F.pandas_udf(run, "double")(z.cast("double"))
