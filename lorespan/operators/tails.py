"""Tails of t, F, chi-squared and r: incomplete beta and gamma functions by continued fractions, for whole batches of rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checks import _row

#: Steps at most; a fraction ends when it stands still, after about the root of the degrees of freedom.
STEPS, STILL, TINY = 20_000, 1e-14, 1e-300


def ln_gamma(x: np.ndarray) -> np.ndarray:
    """Of x above 0: Stirling's series at x + 8, less the logarithms of the steps to there."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - sum(np.log(x + k) for k in range(8))


def _fraction(first: np.ndarray, terms) -> np.ndarray:
    """first + a1 / (b1 + a2 / (b2 + ...)), terms(m) giving a and b of the m-th step, by the ratios of its convergents."""
    nonzero = lambda x: np.where(np.abs(x) < TINY, TINY, x)
    f = c = nonzero(first)
    d = np.zeros_like(f)
    for m in range(1, STEPS + 1):
        a, b = terms(m)
        d = 1 / nonzero(b + a * d)
        c = nonzero(b + a / c)
        f = f * c * d
        if not (np.abs(c * d - 1) > STILL).any():
            break
    return f


def _beta_fraction(a, b, x):
    def terms(m):
        h = m // 2
        if m % 2:
            return -(a + h) * (a + b + h) * x / ((a + 2 * h) * (a + 2 * h + 1)), 1.0
        return h * (b - h) * x / ((a + 2 * h - 1) * (a + 2 * h)), 1.0

    return 1 / _fraction(np.ones_like(x), terms)


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularized incomplete beta function of a, b above 0 and x from 0 to 1: by its fraction on the side where that is short."""
    turn = x >= (a + 1) / (a + b + 2)
    a, b, x = np.where(turn, b, a), np.where(turn, a, b), np.clip(np.where(turn, 1 - x, x), TINY, 1 - 1e-16)
    part = np.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * np.log(x) + b * np.log1p(-x)) * _beta_fraction(a, b, x) / a
    return np.where(turn, 1 - part, part)


def gamma_tail(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The upper regularized incomplete gamma function of a above 0 and x of 0 or more: by a series below a + 1, by a fraction from there."""
    x = np.maximum(x, TINY)
    low, front = x < a + 1, np.exp(a * np.log(x) - x - ln_gamma(a))
    term = total = 1 / a
    for m in range(1, STEPS + 1):
        term = np.where(low, term * x / (a + m), 0.0)
        total = total + term
        if not (term > STILL * total).any():
            break
    y = np.where(low, a + 1, x)  # where the fraction isn't wanted, one that ends soon
    return np.where(low, 1 - front * total, front / _fraction(y + 1 - a, lambda m: (-m * (m - a), y + 2 * m + 1 - a)))


def tail_values(kind: np.ndarray, v: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """p of each statistic, as two_sided_p(); nan where there is none."""
    out, half = np.full(len(v), np.nan), lambda n: np.full(n, 0.5)
    fine = np.isfinite(v)
    for name, ok in (("z", fine), ("t", fine & (one > 0)), ("F", fine & (one > 0) & (two > 0) & (v >= 0)), ("chi2", fine & (one > 0) & (v >= 0)), ("r", fine & (one > 0) & (np.abs(v) <= 1))):
        at = np.flatnonzero(ok & (kind == name))
        if len(at):
            x, a, b = v[at], one[at], two[at]
            if name == "z":
                out[at] = gamma_tail(half(len(at)), x * x / 2)
            elif name == "t":
                out[at] = beta_share(a / 2, half(len(at)), a / (a + x * x))
            elif name == "F":
                out[at] = beta_share(b / 2, a / 2, b / (b + a * x))
            elif name == "chi2":
                out[at] = gamma_tail(a / 2, x / 2)
            else:
                out[at] = beta_share(a / 2, half(len(at)), 1 - x * x)
    return out


def _tails(kind: pd.Series, value: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    with np.errstate(all="ignore"):
        p = tail_values(kind.to_numpy(object), *(x.to_numpy(np.float64, na_value=np.nan) for x in (value, df1, df2)))
    return pd.Series(p).astype("Float64").mask(np.isnan(p))


def two_sided_p(kind: Column, value: Column, df1: Column, df2: Column) -> Column:
    """p of a statistic of kind z, t (df1), F (df1, df2; upper tail), chi2 (df1; upper tail) or r (df1 = n - 2); null for other kinds and for statistics or degrees of freedom that are missing or can't be."""
    return F.pandas_udf(_tails, T.DoubleType())(kind, value.cast("double"), df1.cast("double"), df2.cast("double"))


def statistic_check(df: DataFrame, key: str, kind: str, value: str, df1: str, df2: str, p: str, tolerance: float = 0.0005) -> DataFrame:
    """Reported p against the one that the statistic and its degrees of freedom give, a row for each; kinds as in two_sided_p(). Where there is none, the row is flagged: it can't be checked."""
    rows = df.withColumn("_own", two_sided_p(F.col(kind), F.col(value), F.col(df1), F.col(df2)))
    own = F.col("_own")
    bad = F.coalesce(F.abs(F.col(p) - own) > tolerance, F.lit(True))
    return rows.select(*_row("statcheck", p, F.col(key), F.round(p, 6), F.round(own, 6), bad, F.lit(1)))
