"""Spline pool against a NumPy form of the same definition, and against the linear pool."""
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajens.functions.quantiles import QUANTILE_LEVELS
from trajens.operators.linear_pool import linear_pool
from trajens.operators.spline_pool import GRID, normal_quantile, spline_pool

SCHEMA = "g int, model string, quantile_level double, value double"
ND = NormalDist()


def model_values(p, x, tails="normal", grid=GRID):
    """One model's quantile function on the grid."""
    p, x = np.asarray(p, float), np.asarray(x, float)
    t = (np.arange(1, grid + 1) - 0.5) / grid
    if len(p) == 1:
        return np.full(grid, x[0])
    h, d = np.diff(p), np.diff(x) / np.diff(p)
    m = np.empty(len(p))
    m[0], m[-1] = d[0], d[-1]
    for i in range(1, len(p) - 1):
        w0, w1 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
        m[i] = (w0 + w1) / (w0 / d[i - 1] + w1 / d[i]) if d[i - 1] > 0 and d[i] > 0 else 0.0
    out = np.empty(grid)
    for k, u in enumerate(t):
        if u < p[0] - 1e-12 or u > p[-1] + 1e-12:
            a, b, e = (0, 1, 0) if u < p[0] else (-2, -1, -1)
            if tails == "clamped":
                out[k] = x[e]
                continue
            z = ND.inv_cdf if tails == "normal" else lambda q: math.tan(math.pi * (q - 0.5))
            out[k] = x[e] + (x[b] - x[a]) / (z(p[b]) - z(p[a])) * (z(u) - z(p[e]))
        else:
            i = min(max(int(np.searchsorted(p, u - 1e-12)) - 1, 0), len(p) - 2)
            s = min(max((u - p[i]) / h[i], 0.0), 1.0)
            out[k] = (x[i] * (1 + 2 * s) * (1 - s) ** 2 + h[i] * m[i] * s * (1 - s) ** 2
                      + x[i + 1] * s * s * (3 - 2 * s) + h[i] * m[i + 1] * s * s * (s - 1))
    return out


def _groups(seed=1):
    rng = np.random.default_rng(seed)
    out = {}
    for g in range(25):
        models = {}
        for m in range(int(rng.integers(1, 5))):
            levels = sorted(rng.choice(QUANTILE_LEVELS, int(rng.integers(1, 24)), replace=False)) if g % 3 else QUANTILE_LEVELS
            if g % 5 == 4:  # levels that are in no table
                levels = sorted(set(np.round(rng.uniform(0.002, 0.998, 9), 4)))
            x = np.sort(rng.gamma(2, 10, len(levels)).round(int(rng.integers(0, 4))))  # with ties
            models[f"m{m}"] = (levels, x)
        out[g] = models
    return out


@pytest.mark.parametrize("tails", ["normal", "cauchy", "clamped"])
def test_equals_numpy(spark, tails):
    groups = _groups()
    rows = [(g, m, float(p), float(x)) for g, ms in groups.items() for m, (ps, xs) in ms.items() for p, x in zip(ps, xs)]
    got = {(r.g, r.quantile_level): r.value for r in spline_pool(spark.createDataFrame(rows, SCHEMA), ["g"], tails=tails).collect()}
    assert len(got) == len(groups) * len(QUANTILE_LEVELS)
    for g, ms in groups.items():
        pool = np.concatenate([model_values(*m, tails) for m in ms.values()])
        for p in QUANTILE_LEVELS:
            assert math.isclose(got[g, p], float(np.quantile(pool, p, method="hazen")), rel_tol=1e-7, abs_tol=1e-7), (g, p)


def test_linear_quantile_functions_pool_as_in_the_linear_form(spark):
    rows = [(1, m, p, a + b * p) for m, a, b in (("u", 0.0, 10.0), ("v", 4.0, 3.0), ("w", 5.0, 20.0)) for p in QUANTILE_LEVELS]
    mq = spark.createDataFrame(rows, SCHEMA)
    lin = {r.quantile_level: r.value for r in linear_pool(mq, ["g"]).collect()}
    for r in spline_pool(mq, ["g"], tails="clamped").collect():
        assert abs(r.value - lin[r.quantile_level]) < 2 / GRID, r


def test_tails_and_identical_models(spark):
    # knots of a normal distribution: levels beyond the outermost knot follow it
    levels = [0.1, 0.25, 0.5, 0.75, 0.9]
    rows = [(1, m, p, 100 + 15 * ND.inv_cdf(p)) for m in "ab" for p in levels]
    got = {r.quantile_level: r.value for r in spline_pool(spark.createDataFrame(rows, SCHEMA), ["g"]).collect()}
    for p in (0.01, 0.025, 0.05, 0.95, 0.975, 0.99):
        assert abs(got[p] - (100 + 15 * ND.inv_cdf(p))) < 0.02, p
    for p in levels:
        assert abs(got[p] - (100 + 15 * ND.inv_cdf(p))) < 0.02
    v = [got[p] for p in QUANTILE_LEVELS]
    assert v == sorted(v)


def test_edge_cases(spark):
    rows = [(1, "a", 0.5, 3.0), (1, "b", 0.5, None), (2, "a", 0.25, 1.0), (2, "a", 0.25, 3.0), (2, "a", 0.75, 2.0),
            (None, "a", 0.5, 7.0), (4, "a", 0.5, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.g, r.quantile_level): r.value for r in spline_pool(df, ["g"], levels=[0.01, 0.5, 0.99]).collect()}
    assert {k: v for k, v in got.items() if k[0] != 2} == {(g, p): x for g, x in ((1, 3.0), (None, 7.0)) for p in (0.01, 0.5, 0.99)}
    assert got[2, 0.5] == 2.0  # repeated level: its mean; both knots on one value: constant
    assert spline_pool(df.limit(0), ["g"]).count() == 0
    with pytest.raises(ValueError):
        spline_pool(df, ["g"], tails="none")


def test_normal_quantile(spark):
    ps = [1e-9, 1e-4, 0.002, 0.00135, 0.01, 0.2, 0.4999, 0.5, 0.61, 0.9, 0.9987, 0.9999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for r in df.select("p", normal_quantile(F.col("p")).alias("z")).collect():
        assert math.isclose(r.z, ND.inv_cdf(r.p), rel_tol=1e-9, abs_tol=1e-9), r
