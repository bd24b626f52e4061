import datetime as dt

from pyspark.sql import functions as F

from trajens.operators import prepare as P
from conftest import rows

D = dt.date


def test_weekly_truth_rollup_and_population(spark):
    daily = spark.createDataFrame([
        ("BE", "Belgium", D(2022, 7, 24), 1.0), ("BE", "Belgium", D(2022, 7, 30), 2.0),
        ("BE", "Belgium", D(2022, 7, 31), None), ("BE", "Belgium", D(2022, 8, 1), None),
        ("NL", "Netherlands", D(2022, 7, 25), 5.0),
    ], "location string, location_name string, date date, value double")
    pop = spark.createDataFrame([("BE", 100.0)], "location string, population double")
    out = P.weekly_truth(P.tag_target(daily, "inc case"), pop)
    got = rows(out, "location", "target_end_date", "value", "population", "model")
    assert got == [("BE", D(2022, 7, 30), 3.0, 100.0, "Observed"),
                   ("BE", D(2022, 8, 1), 0.0, 100.0, "Observed"),   # all-NULL week sums to 0
                   ("NL", D(2022, 7, 25), 5.0, None, "Observed")]


def _results(spark, models_per_group):
    data = []
    for g, ms in models_per_group.items():
        for m in ms:
            for s in (1, 2):
                data.append((m, g, "A", "inc case", "1 wk", s, float(s)))
    return spark.createDataFrame(
        data, "model string, location string, scenario_id string, target_variable string, "
              "horizon string, sample int, value double")


def test_min_model_filter_anti_join(spark):
    raw = _results(spark, {"BE": ["a", "b", "c"], "NL": ["a", "b"]})
    rounds = spark.createDataFrame([(2, D(2022, 7, 24), D(2022, 7, 30))],
                                   "round int, origin_date date, submission_window_end date")
    res = P.add_horizon_dates(raw, rounds, 2)
    kept = P.min_model_filter(res, 3)
    assert {r.location for r in kept.collect()} == {"BE"}
    assert kept.count() == 6
    assert {r.target_end_date for r in kept.collect()} == {D(2022, 7, 30)}


def test_drop_superseded(spark):
    df = spark.createDataFrame([("X",), ("X_update",), ("Y_update",)], "model string")
    assert rows(P.drop_superseded(df, "X"), "model") == [("X",), ("Y_update",)]
    only = spark.createDataFrame([("X_update",)], "model string")
    assert P.drop_superseded(only, "X").count() == 1


def test_population_at_first_week_and_per_100k(spark):
    obs = spark.createDataFrame([
        ("BE", "Belgium", "inc case", D(2022, 7, 30), 10.0, 200.0),
        ("BE", "Belgium", "inc case", D(2022, 8, 6), 20.0, 999.0),
    ], "location string, location_name string, target_variable string, target_end_date date, "
       "value double, population double")
    res = spark.createDataFrame([("BE", "inc case", D(2022, 8, 6), 4.0)],
                                "location string, target_variable string, target_end_date date, value double")
    out = P.attach_population(P.attach_observed(res, obs), obs).collect()[0]
    assert out.population == 200.0
    assert out.value_100k == 4.0 / 200.0 * 100000
    assert out.obs_100k == 20.0 / 200.0 * 100000
