"""Tail probabilities of the usual test statistics, for tables with one row per test."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _continued_beta(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _continued_beta(a, b, x) / a
    return 1.0 - front * _continued_beta(b, a, 1.0 - x) / b


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def _rowwise(fn, *cols: pd.Series) -> pd.Series:
    def one(values):
        if any(v is None or v != v for v in values):
            return None
        return fn(*[float(v) for v in values])
    return pd.Series([one(v) for v in zip(*cols)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return _rowwise(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), z)


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(
        lambda v, d: incomplete_beta(d / 2.0, 0.5, d / (d + v * v)) if d > 0 else None, t, df)


@F.pandas_udf(T.DoubleType())
def f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _rowwise(
        lambda v, a, b: None if a <= 0 or b <= 0 else 1.0 if v <= 0
        else incomplete_beta(b / 2.0, a / 2.0, b / (b + a * v)), f, d1, d2)


@F.pandas_udf(T.DoubleType())
def chi2_upper(x: pd.Series, k: pd.Series) -> pd.Series:
    return _rowwise(lambda v, d: upper_gamma(d / 2.0, v / 2.0) if d > 0 else None, x, k)


@functools.cache
def _u_tail(n: int, m: int) -> tuple[float, ...]:
    """P(U >= u) for u = 0 .. n * m, without ties."""
    counts = [1]
    for i in range(1, n + 1):  # multiply by (1 - x^(m + i)) / (1 - x^i)
        wide = counts + [0] * (m + i)
        for u in range(len(wide) - 1, m + i - 1, -1):
            wide[u] -= wide[u - m - i]
        for u in range(i, len(wide)):
            wide[u] += wide[u - i]
        counts = wide[: i * m + 1]
    total, above, out = sum(counts), 0, []
    for c in reversed(counts):
        above += c
        out.append(above / total)
    return tuple(reversed(out))


@F.pandas_udf(T.DoubleType())
def exact_u_two_sided(n_a: pd.Series, n_b: pd.Series, u: pd.Series) -> pd.Series:
    """Exact two-sided p of the Mann-Whitney statistic; NULL where ``u`` is."""
    out = []
    for a, b, x in zip(n_a, n_b, u):
        if x is None or x != x:
            out.append(None)
            continue
        a, b = sorted((int(a), int(b)))
        out.append(min(1.0, 2.0 * _u_tail(a, b)[math.ceil(max(x, a * b - x))]))
    return pd.Series(out, dtype="float64")
