import datetime as dt

from pyspark.sql import functions as F

from trajens.operators import shape as S
from trajens.operators import weighting as W
from trajens.session import checkpoint_dir, materialize


def test_materialize_writes_under_checkpoint_dir(spark):
    df = spark.range(0, 100).withColumn("v", F.col("id") * 2)
    m = materialize(df, "t")
    assert m.count() == 100 and m.agg(F.sum("v")).first()[0] == 9900
    root = checkpoint_dir(spark).split(":", 1)[-1].rstrip("/")
    assert m.inputFiles() and all(root in f and "/tables/t-" in f for f in m.inputFiles())


def test_mask_history_hides_current_and_later_weeks(spark):
    d = [dt.date(2022, 1, 1) + dt.timedelta(days=7 * i) for i in range(3)]
    res = spark.createDataFrame([("BE", "m", 1, d[i], 1.0, float(i)) for i in range(3)],
                                "location string, model string, sample int, target_end_date date, "
                                "value_100k double, obs_100k double")
    out = {(r.forecast_date, r.target_end_date): r.obs_100k for r in W.mask_history(res).collect()}
    assert len(out) == 9
    assert out[(d[1], d[0])] == 0.0 and out[(d[1], d[1])] is None and out[(d[2], d[1])] == 1.0


def test_interval_width_change_bounds(spark):
    f0 = dt.date(2022, 1, 1)
    rows = []
    for h, up in ((4, 12.0), (16, 10.0)):
        for wk in range(20):
            date = f0 + dt.timedelta(days=7 * wk)
            for q, v in (("q0.25", 1.0), ("q0.5", 2.0), ("q0.75", up)):
                rows.append((date - dt.timedelta(days=7 * h), date, h, "Weighted", "BE", "inc case", q, v))
    weekly = spark.createDataFrame(rows, "forecast_date date, target_end_date date, horizon int, "
                                         "scenario_id string, location string, target_variable string, "
                                         "quantile string, value double")
    out = {r.interval: r for r in S.interval_width_change(weekly).collect()}
    assert abs(out[0.5].diff - 0.2) < 1e-12 and out[0.5].upper_recent == 12.0
    # a first forecast date without history: NULL values set no bound and no width
    early = f0 - dt.timedelta(days=70)
    none = spark.createDataFrame([(early - dt.timedelta(days=112), early, 16, "Weighted", "BE", "inc case", q, None)
                                  for q in ("q0.25", "q0.5", "q0.75")], weekly.schema)
    again = {r.interval: r for r in S.interval_width_change(weekly.unionByName(none)).collect()}
    assert again[0.5] == out[0.5]


def test_checkpoint_dir_on_a_cluster_must_be_named(spark, monkeypatch):
    import pytest

    from trajens import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Fake())


def test_plot_table_hides_weighted_past_and_uses_given_facets(spark):
    d = [dt.date(2022, 1, 1) + dt.timedelta(days=7 * i) for i in range(3)]
    res = spark.createDataFrame([("BE", "inc case", d[i], "A", "m", 1, 1.0 + i, 5.0 if i < 2 else None) for i in range(3)],
                                "location string, target_variable string, target_end_date date, scenario_id string, "
                                "model string, sample int, value_100k double, obs_100k double")
    ens = spark.createDataFrame([(2, "BE", "inc case", d[i], s, m, "q0.5", 9.0) for i in range(3)
                                 for m, s in (("Quantiles", "A"), ("Linear pool", "A"), ("Trajectories", "Weighted"))],
                                "round int, location string, target_variable string, target_end_date date, "
                                "scenario_id string, model string, quantile string, value double")
    facets = spark.createDataFrame([("None", "all", 1), ("Weighted", "w", 2)], "level string, label string, ord int")
    out = S.plot_table(ens, res, facets).collect()
    by = {(r.model, r.target_end_date): r for r in out}
    assert {r.model for r in out} == {"all", "w", None} and len(out) == 9
    assert by[("w", d[0])].median is None and by[("w", d[1])].median == 9.0 and by[("w", d[1])].obs_100k == 5.0
    assert by[(None, d[0])].median == 9.0 and by[(None, d[0])].obs_100k is None and by[("all", d[0])].obs_100k == 5.0


def test_weekly_plot_keeps_chosen_weightings_in_order(spark):
    rows = [("t", dt.date(2022, 1, 1), dt.date(2022, 2, 1), w, s, 3, 4, 1.0, "q0.5", 2.0)
            for w, s in (("4 weeks ago", "Weighted"), ("5 weeks ago", "Weighted"), ("Unweighted", "Unweighted"))]
    df = spark.createDataFrame(rows, "target string, forecast_date date, target_end_date date, weighting string, "
                                     "scenario_id string, n_weeks_scored long, horizon int, obs_100k double, "
                                     "quantile string, value double")
    out = S.weekly_plot_table(df)
    assert sorted((r.weighting_order, r.weighting) for r in out.collect()) == [(3, "4 weeks ago"), (4, "Unweighted")]
    w, u = S.split_weighted(out)
    assert w.count() == 1 and u.count() == 1
