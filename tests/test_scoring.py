import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from trajens.functions.quantiles import QUANTILE_LEVELS
from trajens.operators import evaluation as E
from trajens.operators import weighting as W

D0 = dt.date(2022, 7, 2)


def _week(i):
    return D0 + dt.timedelta(days=7 * i)


def _results(spark, obs_weeks=4, weeks=6):
    """3 models x 4 samples x 6 weeks; observations for the first weeks."""
    rng = np.random.default_rng(5)
    obs = [10.0, 12.0, 15.0, 11.0, 9.0, 8.0]
    data = []
    for m in ("a", "b", "c"):
        for s in range(4):
            for i in range(weeks):
                v = float(round(obs[i] + rng.normal(0, 3), 3))
                o = obs[i] if i < obs_weeks else None
                data.append(("BE", "inc case", m, s, "A", _week(i), v, o))
    return spark.createDataFrame(
        data, "location string, target_variable string, model string, sample int, "
              "scenario_id string, target_end_date date, value_100k double, obs_100k double"), data


def test_mae_and_weights(spark):
    res, data = _results(spark)
    mae = W.score_trajectories(res)
    got = {(r.model, r.sample): (r.mae, r.n_weeks_scored) for r in mae.collect()}
    for (m, s), (v, n) in got.items():
        errs = [abs(d[6] - d[7]) for d in data if d[2] == m and d[3] == s and d[7] is not None]
        assert n == 4 and math.isclose(v, sum(errs) / len(errs), rel_tol=1e-12)
    wts = W.trajectory_weights(res, mae)
    sums = wts.groupBy("target_end_date").agg(F.sum("weight").alias("s")).collect()
    assert all(math.isclose(r.s, 1.0, rel_tol=1e-12) for r in sums)


def test_expanding_mae_equals_masked_rescoring(spark):
    res, data = _results(spark)
    got = {(r.forecast_date, r.model, r.sample): (r.mae, r.n_weeks_scored)
           for r in W.expanding_mae(res).collect()}
    dates = sorted({d[5] for d in data})
    n_expected = 0
    for f in dates:
        for m in ("a", "b", "c"):
            for s in range(4):
                errs = [abs(d[6] - d[7]) for d in data
                        if d[2] == m and d[3] == s and d[7] is not None and d[5] < f]
                if not errs:
                    assert (f, m, s) not in got
                    continue
                n_expected += 1
                mae, n = got[(f, m, s)]
                assert n == len(errs) and math.isclose(mae, sum(errs) / len(errs), rel_tol=1e-12)
    assert len(got) == n_expected


def test_expanding_weights_sum_to_one_and_history_grows(spark):
    res, _ = _results(spark)
    ew = W.expanding_weights(res, min_horizon=0)
    assert ew.where(F.col("target_end_date") < F.col("forecast_date")).count() == 0
    s = (ew.groupBy("forecast_date", "target_end_date").agg(F.sum("weight").alias("s"))
         .where(F.col("s").isNotNull()).collect())
    assert s and all(math.isclose(r.s, 1.0, rel_tol=1e-12) for r in s)
    first = ew.where(F.col("forecast_date") == _week(0))
    assert first.where(F.col("weight").isNotNull()).count() == 0


def test_weekly_ensembles_shapes(spark):
    res, _ = _results(spark)
    out = W.weekly_ensembles(res)
    kinds = {r.scenario_id for r in out.select("scenario_id").distinct().collect()}
    assert kinds == {"Weighted", "Unweighted"}
    assert out.where(F.col("horizon") < 0).count() == 0
    # first forecast date has no history: weeks scored 0, weighted value NULL
    first = out.where((F.col("forecast_date") == _week(0)) & (F.col("scenario_id") == "Weighted"))
    assert {r.n_weeks_scored for r in first.collect()} == {0}
    assert first.where(F.col("value").isNotNull()).count() == 0


def _forecasts(spark, y, qs, model="m"):
    data = [(model, "t", p, float(q), float(y)) for p, q in zip(QUANTILE_LEVELS, qs)]
    return spark.createDataFrame(data, "model string, target string, quantile double, "
                                       "prediction double, true_value double")


def test_wis_pinball_equals_interval_form(spark):
    qs = np.linspace(1, 50, len(QUANTILE_LEVELS))
    f = _forecasts(spark, 20.0, qs)
    pin = E.wis(f, ["model"], log=False).first().interval_score
    iv = E.interval_scores(f, ["model", "target"], log=False)
    # mean of alpha/2 weighted interval scores over the 12 intervals, with
    # interval 0 (median) counted once for each of its two sides
    w = {r.interval: r.interval_score for r in iv.collect()}
    n_levels = len(QUANTILE_LEVELS)
    total = sum(v * (1 if k == 0 else 2) for k, v in w.items()) / n_levels
    assert math.isclose(pin, total, rel_tol=1e-12)


def test_pairwise_two_models_is_ratio(spark):
    scores = spark.createDataFrame(
        [("a", "t", 2.0), ("b", "t", 8.0), ("c", "t", 4.0), ("a", "u", 1.0), ("b", "u", 3.0)],
        "model string, target string, interval_score double")
    out = {(r.model, r.target): r for r in E.pairwise_skill(scores, ["target"], "b").collect()}
    assert math.isclose(out[("a", "u")].scaled_rel_skill, 1 / 3, rel_tol=1e-12)
    assert math.isclose(out[("a", "t")].scaled_rel_skill, 2 / 8, rel_tol=1e-12)
    assert math.isclose(out[("c", "t")].scaled_rel_skill, 4 / 8, rel_tol=1e-12)
    g = (2.0 * 8.0 * 4.0) ** (1 / 3)
    assert math.isclose(out[("a", "t")].relative_skill, 2.0 / g, rel_tol=1e-12)


def test_log_scale_keeps_null_and_floors_negative(spark):
    f = spark.createDataFrame([(None, 1.0), (-5.0, 1.0)], "prediction double, true_value double")
    got = E.log_scale(f).collect()
    assert got[0].prediction is None
    assert math.isclose(got[1].prediction, math.log(1e-5))


def test_perfect_trajectory_and_floor(spark):
    rows = [("BE", "inc case", "a", 1, "A", _week(0), 5.0, 5.0 + 1e-13), ("BE", "inc case", "b", 1, "A", _week(0), 7.0, 5.0)]
    res = spark.createDataFrame(rows, "location string, target_variable string, model string, sample int, "
                                "scenario_id string, target_end_date date, value_100k double, obs_100k double")
    got = {r.model: r for r in W.score_trajectories(res).collect()}
    assert got["a"].mae == 0.0 and math.isclose(got["a"].inv_mae, 1 / W.MAE_FLOOR) and got["b"].inv_mae == 0.5
    assert {r.model: r.inv_mae for r in W.score_trajectories(res, mae_floor=None).collect()} == {"a": None, "b": 0.5}


def test_min_weeks_leaves_out_short_histories(spark):
    res, _ = _results(spark)
    out = W.weekly_ensembles(res, min_weeks=3).where("scenario_id = 'Weighted'")
    known = {r.n_weeks_scored for r in out.where("value is not null").collect()}
    assert known and min(known) >= 3


def test_unknown_truth_is_no_hit(spark):
    f = spark.createDataFrame([("m", "t", p, 1.0 + p, None) for p in (0.25, 0.5, 0.75)],
                              "model string, target string, quantile double, prediction double, true_value double")
    got = E.interval_scores(f, ["model", "target"], log=False).collect()
    assert got and all(r.interval_score is None and r.overprediction is None and r.dispersion is not None for r in got)


def test_pairwise_uses_each_pairs_own_overlap(spark):
    scores = spark.createDataFrame(
        [("a", "t", "A", 1.0), ("b", "t", "A", 2.0), ("a", "t", "B", 3.0), ("b", "t", "B", 9.0), ("c", "t", "A", 4.0)],
        "model string, target string, scenario_id string, interval_score double")
    got = {r.model: r for r in E.pairwise_skill(scores, ["target"], "a").collect()}
    assert math.isclose(got["b"].mean_scores_ratio, 11 / 4) and math.isclose(got["c"].mean_scores_ratio, 4.0)
    theta = {"a": (1 * (4 / 11) * (1 / 4)) ** (1 / 3), "b": (11 / 4 * 1 * (2 / 4)) ** (1 / 3), "c": (4 * 2 * 1) ** (1 / 3)}
    for m, t in theta.items():
        assert math.isclose(got[m].relative_skill, t) and math.isclose(got[m].scaled_rel_skill, t / theta["a"])
    static = E.static_rel_wis(E.pairwise_skill(scores, ["target"], "a"), "a").collect()
    assert sorted(r.model for r in static) == ["b", "c"]


def test_boxplot_outliers(spark):
    rw = spark.createDataFrame([("t", float(v)) for v in (1, 2, 3, 4, 5, 50)] + [("u", 1.0)], "target string, rel_wis double")
    assert [(r.target, r.rel_wis) for r in E.boxplot_outliers(rw).collect()] == [("t", 50.0)]


def test_wis_of_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for m in ("a", "b"):
        for t in range(4):
            y = float(rng.gamma(3, 5))
            rows += [(m, t, p, float(q), y) for p, q in zip(QUANTILE_LEVELS, np.sort(rng.gamma(3, 5, len(QUANTILE_LEVELS))))]
    schema = "model string, t int, quantile double, prediction double, true_value double"
    df = spark.createDataFrame(rows, schema)
    whole = {r.model: r for r in E.wis_of_pairs(df, ["model", "t"], ["model"]).collect()}
    plain = {r.model: r.interval_score for r in E.wis(df, ["model"]).collect()}
    for m, r in whole.items():
        assert math.isclose(r.interval_score, plain[m], rel_tol=1e-12) and (r.levels, r.incomplete_units) == (4 * 23, 0)
    # a level gone in one unit: its partner counts no more, everything else as before
    less = df.where(~((F.col("model") == "a") & (F.col("t") == 2) & (F.col("quantile") == 0.9)))
    got = {r.model: r for r in E.wis_of_pairs(less, ["model", "t"], ["model"]).collect()}
    kept = less.where(~((F.col("model") == "a") & (F.col("t") == 2) & (F.col("quantile") == 0.1)))
    assert math.isclose(got["a"].interval_score, E.wis(kept, ["model"]).where("model = 'a'").first().interval_score, rel_tol=1e-12)
    assert (got["a"].levels, got["a"].incomplete_units) == (90, 1) and got["b"] == whole["b"]
    # no median, a NULL prediction, an unknown truth
    odd = spark.createDataFrame([("c", 1, 0.25, 1.0, 2.0), ("c", 1, 0.75, 3.0, 2.0), ("c", 2, 0.25, None, 2.0), ("c", 2, 0.75, 3.0, 2.0),
                                 ("c", 2, 0.5, 2.0, 2.0), ("d", 1, 0.5, 1.0, None)], schema)
    got = {r.model: r for r in E.wis_of_pairs(odd, ["model", "t"], ["model"], log=False).collect()}
    assert math.isclose(got["c"].interval_score, (2 * 0.25 * 2.0 + 0.0) / 3) and (got["c"].levels, got["c"].incomplete_units) == (3, 2)
    assert got["d"].interval_score is None and (got["d"].levels, got["d"].incomplete_units) == (0, 1)


def test_boxplot_keeps_the_null_group(spark):
    rw = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 30.0), ("t", 1.0)], "target string, rel_wis double")
    got = {r.target: r for r in E.boxplot_stats(rw).collect()}
    assert set(got) == {None, "t"} and got[None].middle == 2.0
