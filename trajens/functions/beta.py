"""Regularised incomplete beta I_x(a, b) — vectorised, for the weighted
Harrell–Davis quantile.

Spark has no beta function. Two column forms are offered:

* :func:`beta_cdf` — Arrow-batched pandas UDF over a NumPy continued fraction
  (DLMF 8.17.22, with the symmetry swap ``I_x(a,b) = 1 - I_{1-x}(b,a)``).
* :func:`beta_cdf_jvm` — ``reflect`` into commons-math3 (on Spark's classpath);
  exact reference, but interpreted and string-typed, so slower per row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_DEEPEST = 1 << 16


def _lgamma(v: np.ndarray) -> np.ndarray:
    uniq, inv = np.unique(v, return_inverse=True)
    lg = np.array([math.lgamma(u) for u in uniq], dtype=np.float64)
    return lg[inv]


def _fraction(x, a, b, depth: int) -> np.ndarray:
    """``1 + d1/(1 + d2/(1 + ...))`` cut after ``depth`` terms, from the inside out, with the
    coefficients of DLMF 8.17.22: ``d_2m = m (b-m) x / ((a+2m-1)(a+2m))`` and
    ``d_2m+1 = -(a+m)(a+b+m) x / ((a+2m)(a+2m+1))``."""
    value = np.ones_like(x)
    for k in range(depth, 0, -1):
        m = k // 2
        top = m * (b - m) if k % 2 == 0 else -(a + m) * (a + b + m)
        value = 1.0 + top * x / ((a + k - 1) * (a + k)) / value
    return value


def _settled_fraction(x, a, b) -> np.ndarray:
    """The fraction at doubled depths until it no longer moves; NaN where it still does at the
    deepest (never an unconverged number)."""
    out, depth = _fraction(x, a, b, 16), 16
    todo = np.arange(len(x))
    while len(todo) and depth < _DEEPEST:
        depth *= 2
        new = _fraction(x[todo], a[todo], b[todo], depth)
        moved = np.abs(new - out[todo]) > 4e-16 * np.abs(new)
        out[todo] = new
        todo = todo[moved]
    out[todo] = np.nan
    return out


def regularized_beta(x, a, b) -> np.ndarray:
    """I_x(a, b) for arrays; NaN where any input is NaN or a, b <= 0."""
    x = np.asarray(x, dtype=np.float64)
    a = np.asarray(a, dtype=np.float64)
    b = np.asarray(b, dtype=np.float64)
    x, a, b = np.broadcast_arrays(x, a, b)
    out = np.full(x.shape, np.nan)
    valid = ~(np.isnan(x) | np.isnan(a) | np.isnan(b)) & (a > 0) & (b > 0)
    out[valid & (x <= 0)] = 0.0
    out[valid & (x >= 1)] = 1.0
    inner = valid & (x > 0) & (x < 1)
    if inner.any():
        xi, ai, bi = x[inner], a[inner], b[inner]
        lbt = _lgamma(ai + bi) - _lgamma(ai) - _lgamma(bi)
        front = np.exp(lbt + ai * np.log(xi) + bi * np.log1p(-xi))
        swap = xi >= (ai + 1.0) / (ai + bi + 2.0)
        res = np.empty_like(xi)
        ns = ~swap
        if ns.any():
            res[ns] = front[ns] / _settled_fraction(xi[ns], ai[ns], bi[ns]) / ai[ns]
        if swap.any():
            res[swap] = 1.0 - front[swap] / _settled_fraction(1.0 - xi[swap], bi[swap], ai[swap]) / bi[swap]
        out[inner] = np.clip(res, 0.0, 1.0)
    return out


@pandas_udf(DoubleType())
def _beta_udf(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(regularized_beta(x.to_numpy(dtype=np.float64, na_value=np.nan),
                                      a.to_numpy(dtype=np.float64, na_value=np.nan),
                                      b.to_numpy(dtype=np.float64, na_value=np.nan)))


def beta_cdf(x, a, b) -> Column:
    """I_x(a, b) as a vectorised (Arrow) column expression; NULL-safe."""
    return _beta_udf(x, a, b)


def beta_steps(share, before, last, size, levels, tail: float):
    """Harrell–Davis factors of positions: I_c(a, b) for c = ``share`` and, per level p, a = size * p,
    b = size * (1-p), and whether c is the first share that counts whole (I = 1). Rows x levels.

    A beta(a, b) variable with mean p is within sqrt(T / (2 (a+b+1))) of p but for a probability of
    2 exp(-T) (it is sub-Gaussian with variance factor 1 / (4 (a+b+1))): shares further below give 0,
    shares further above count whole. Between, Chernoff's bound exp(-(a+b) KL(p, c)) on the smaller
    tail settles most of the others; the continued fraction is taken only where neither does."""
    c = np.where(last, 1.0, np.minimum(share, 1.0))[:, None]
    p, n = np.asarray(levels)[None, :], size[:, None]
    with np.errstate(all="ignore"):
        t = np.sqrt((tail + 0.7) / (2.0 * (n + 1.0)))
        whole = (c >= 1.0) | (c - p > t)
        first = whole & ~((before[:, None] - 1e-12 >= 1.0) | (before[:, None] - 1e-12 - p > t))
        far = n * (p * np.log(c / p) + (1.0 - p) * np.log1p((p - c) / (1.0 - p))) < -tail
    value = np.where(c > p, 1.0, 0.0)
    row, col = np.nonzero(~whole & (c > 0.0) & (p - c <= t) & ~far)
    value[whole] = 0.0
    value[row, col] = regularized_beta(c[row, 0], size[row] * p[0, col], size[row] * (1.0 - p[0, col]))
    return value, first


def beta_cdf_jvm(x: Column, a: Column, b: Column) -> Column:
    """I_x(a, b) through commons-math3 ``Beta.regularizedBeta``; callers must
    keep NULLs away (``reflect`` fails on NULL arguments)."""
    return F.call_function(
        "reflect", F.lit("org.apache.commons.math3.special.Beta"), F.lit("regularizedBeta"),
        x.cast("double"), a.cast("double"), b.cast("double")).cast("double")
