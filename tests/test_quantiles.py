import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from trajens.functions.beta import beta_cdf, beta_cdf_jvm, regularized_beta
from trajens.functions.quantiles import QUANTILE_LEVELS
from trajens.operators import quantiles as Q
from trajens.operators.linear_pool import linear_pool
from trajens.operators.weighting import weighted_quantile

D = dt.date(2022, 7, 30)
KEYS = ["round", "location", "target_variable", "target_end_date", "scenario_id"]


def _results(spark, values_by_model, location="BE"):
    data = []
    for m, vals in values_by_model.items():
        for s, v in enumerate(vals):
            data.append((2, location, "inc case", D, "A", m, s, float(v)))
    return spark.createDataFrame(
        data, "round int, location string, target_variable string, target_end_date date, "
              "scenario_id string, model string, sample int, value_100k double")


def test_type7_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = {"a": rng.gamma(2, 10, 37).round(3), "b": rng.gamma(3, 5, 21).round(3)}
    res = _results(spark, vals)
    got = {r.quantile_level: r.value for r in Q.ensemble_trajectories(res).collect()}
    pooled = np.concatenate(list(vals.values()))
    for p in QUANTILE_LEVELS:
        assert math.isclose(got[p], np.quantile(pooled, p), rel_tol=1e-12, abs_tol=1e-12)
    assert Q.ensemble_trajectories(res).select("n").first().n == 58


def test_quantile_ensemble_is_median_of_model_quantiles(spark):
    vals = {"a": [1, 2, 3, 4], "b": [10, 20, 30, 40], "c": [5, 6, 7, 8]}
    mq = Q.model_quantiles(_results(spark, vals))
    ens = {r.quantile_level: (r.value, r.n) for r in Q.ensemble_quantiles(mq).collect()}
    for p in QUANTILE_LEVELS:
        exp = np.median([np.quantile(v, p) for v in vals.values()])
        assert math.isclose(ens[p][0], exp, rel_tol=1e-12)
        assert ens[p][1] == 3


def test_quantiles_monotone_in_level(spark):
    rng = np.random.default_rng(7)
    res = _results(spark, {"a": rng.normal(50, 9, 40), "b": rng.normal(60, 4, 40)})
    for df in (Q.ensemble_trajectories(res), linear_pool(Q.model_quantiles(res))):
        v = [r.value for r in df.orderBy("quantile_level").collect()]
        assert len(v) == len(QUANTILE_LEVELS)
        assert all(b >= a - 1e-9 for a, b in zip(v, v[1:]))


def test_linear_pool_of_identical_models_is_the_model(spark):
    vals = [3, 9, 1, 4, 4, 7, 12, 30, 2, 8]
    res = _results(spark, {"a": vals, "b": vals, "c": vals})
    mq = Q.model_quantiles(res)
    pool = {r.quantile_level: r.value for r in linear_pool(mq).collect()}
    for p in QUANTILE_LEVELS:
        assert math.isclose(pool[p], float(np.quantile(vals, p)), abs_tol=1e-7), p


def test_linear_pool_two_point_models(spark):
    # model a is uniform on [0, 1] between its q0.01..q0.99 knots, b on [1, 2]:
    # the pooled median sits at the boundary 1.0
    mq = spark.createDataFrame(
        [(2, "BE", "inc case", D, "A", m, p, lo + (p - 0.01) / 0.98)
         for m, lo in (("a", 0.0), ("b", 1.0)) for p in QUANTILE_LEVELS],
        "round int, location string, target_variable string, target_end_date date, "
        "scenario_id string, model string, quantile_level double, value double")
    pool = {r.quantile_level: r.value for r in linear_pool(mq).collect()}
    assert math.isclose(pool[0.5], 1.0, abs_tol=1e-9)
    assert pool[0.25] < 1.0 < pool[0.75]


def _binom_beta(x, a, b):
    """I_x(a, b) for integer a, b: binomial tail (independent of the code)."""
    n = a + b - 1
    return sum(math.comb(n, j) * x ** j * (1 - x) ** (n - j) for j in range(a, n + 1))


def test_regularized_beta_against_binomial_tail():
    for a in (1, 2, 5, 30):
        for b in (1, 3, 17, 60):
            for x in (0.0, 0.01, 0.3, 0.5, 0.77, 0.999, 1.0):
                assert math.isclose(regularized_beta(x, a, b).item(), _binom_beta(x, a, b),
                                    rel_tol=1e-10, abs_tol=1e-13), (x, a, b)


def test_beta_udf_agrees_with_commons_math(spark):
    rng = np.random.default_rng(3)
    pts = [(float(x), float(a), float(b)) for x, a, b in
           zip(rng.uniform(0, 1, 300), rng.uniform(0.05, 400, 300), rng.uniform(0.05, 400, 300))]
    df = spark.createDataFrame(pts, "x double, a double, b double")
    got = df.select(beta_cdf(F.col("x"), F.col("a"), F.col("b")).alias("py"),
                    beta_cdf_jvm(F.col("x"), F.col("a"), F.col("b")).alias("jvm")).collect()
    assert max(abs(r.py - r.jvm) for r in got) < 1e-9


def _hd_numpy(x, w, p):
    """Weighted Harrell-Davis quantile written directly from its definition."""
    o = np.argsort(x, kind="stable")
    x, w = np.asarray(x, float)[o], np.asarray(w, float)[o]
    nw = w.sum() ** 2 / (w ** 2).sum()
    a, b = (nw + 1) * p, (nw + 1) * (1 - p)
    c = np.concatenate([[0.0], np.cumsum(w) / w.sum()])
    c[-1] = 1.0
    ib = regularized_beta(c, a, b)
    return float(np.sum(x * np.diff(ib)))


def test_weighted_quantile_matches_definition(spark):
    rng = np.random.default_rng(11)
    data, expect = [], {}
    for g in range(4):
        n = int(rng.integers(1, 40))
        x = rng.gamma(2, 30, n).round(4)
        w = rng.uniform(0.1, 3, n)
        for i in range(n):
            data.append((g, i, float(x[i]), float(w[i])))
        for p in QUANTILE_LEVELS:
            expect[(g, p)] = _hd_numpy(x, w, p)
    df = spark.createDataFrame(data, "g int, i int, v double, w double")
    got = weighted_quantile(df, ["g"], "v", "w").collect()
    assert len(got) == 4 * len(QUANTILE_LEVELS)
    for r in got:
        assert math.isclose(r.value, expect[(r.g, r.quantile_level)], rel_tol=1e-9, abs_tol=1e-9)


def test_weighted_quantile_null_weight_gives_null(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, None), (2, 5.0, 2.0)],
                               "g int, v double, w double")
    got = {(r.g, r.quantile_level): r.value for r in weighted_quantile(df, ["g"], "v", "w").collect()}
    assert got[(1, 0.5)] is None
    assert got[(2, 0.5)] == 5.0


def _pool_rows(spark, models, level=QUANTILE_LEVELS):
    """models: {(group, model): values at the levels}"""
    return spark.createDataFrame(
        [(g, "BE", "inc case", D, "A", m, p, float(v)) for (g, m), vs in models.items() for p, v in zip(level, vs)],
        "round int, location string, target_variable string, target_end_date date, "
        "scenario_id string, model string, quantile_level double, value double")


def _pool_reference(models, p):
    """Least x at which the mean of the models' piecewise linear CDFs reaches p, by exact fractions."""
    from fractions import Fraction as Fr
    cdfs = []
    for vs in models:
        ks = {}
        for q, v in zip(QUANTILE_LEVELS, vs):
            x = Fr(round(float(v), 9))
            lo, hi = ks.get(x, (Fr(str(q)), Fr(str(q))))
            ks[x] = (min(lo, Fr(str(q))), max(hi, Fr(str(q))))
        cdfs.append(sorted((x, lo, hi) for x, (lo, hi) in ks.items()))
    xs = sorted({x for c in cdfs for x, *_ in c})

    def at(c, x):
        if x < c[0][0]:
            return Fr(0), Fr(0)
        if x > c[-1][0]:
            return Fr(1), Fr(1)
        for i, (kx, lo, hi) in enumerate(c):
            if kx == x:
                return (Fr(0) if i == 0 else lo), (Fr(1) if i == len(c) - 1 else hi)
            if kx > x:
                px, _, ph = c[i - 1]
                v = ph + (lo - ph) * (x - px) / (kx - px)
                return v, v
    prev = None
    for x in xs:
        left = sum(at(c, x)[0] for c in cdfs) / len(cdfs)
        right = sum(at(c, x)[1] for c in cdfs) / len(cdfs)
        p_ = Fr(str(p))
        if right >= p_:
            if prev is None or p_ > left:
                return float(x)
            return float(prev[0] + (p_ - prev[1]) * (x - prev[0]) / (left - prev[1]))
        prev = (x, right)


def test_linear_pool_of_disjoint_and_tied_models(spark):
    rng = np.random.default_rng(8)
    groups = {}
    for g in range(40):
        lo, hi = np.sort(rng.normal(1000, 0.01, 23)), np.sort(rng.normal(2000, 0.01, 23))
        groups[g] = [lo, hi]
    for g in range(40, 60):  # near and exact ties within and between models
        base = np.sort(rng.integers(0, 6, 23)).astype(float)
        groups[g] = [base, base + 1e-7, np.round(base / 2) * 2]
    df = _pool_rows(spark, {(g, f"m{i}"): vs for g, ms in groups.items() for i, vs in enumerate(ms)})
    got = {(r["round"], r.quantile_level): r.value for r in linear_pool(df).collect()}
    for g, ms in groups.items():
        for p in QUANTILE_LEVELS:
            assert math.isclose(got[(g, p)], _pool_reference(ms, p), rel_tol=1e-9, abs_tol=1e-6), (g, p)
    assert all(got[(g, 0.5)] == round(float(groups[g][0][-1]), 9) for g in range(40))
