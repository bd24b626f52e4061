import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from trajens.operators import peaks as K
from trajens.operators import shape as S
from trajens.operators.ranking import global_row_number
from conftest import rows


def _traj(spark, values):
    d0 = dt.date(2022, 1, 1)
    data = [(1, "m", "A", "BE", "inc case", d0 + dt.timedelta(days=7 * i), v)
            for i, v in enumerate(values)]
    return spark.createDataFrame(data, "sample int, model string, scenario_id string, location string, "
                                       "target_variable string, target_end_date date, value double")


def test_peaks_strict_centred_window(spark):
    #          0    1    2    3    4    5    6    7    8    9   10
    vals = [9.0, 1.0, 2.0, 5.0, 2.0, 1.0, 3.0, 3.0, 1.0, 0.0, 9.0]
    got = [r.value for r in K.detect_peaks(_traj(spark, vals)).collect()]
    assert got == [5.0]                       # plateau 3,3 is not strict; edges never peak
    assert K.flag_peaks(_traj(spark, vals)).where("peak").count() == 1


def test_peak_with_null_in_window_is_not_a_peak(spark):
    vals = [1.0, None, 5.0, 2.0, 1.0, 0.0]
    assert K.detect_peaks(_traj(spark, vals)).count() == 0


def test_peak_counts_and_quantiles(spark):
    d = _traj(spark, [0.0, 1.0, 5.0, 1.0, 0.0, 1.0, 6.0, 1.0, 0.0])
    counts = K.peaks_per_trajectory(K.detect_peaks(d)).collect()
    assert [r.peaks for r in counts] == [2]
    q = K.peak_count_quantiles(K.detect_peaks(d)).first()
    assert (q.q0_05, q.q0_5, q.q0_95) == (2.0, 2.0, 2.0)


def test_icc_oneway(spark):
    a = [1.0, 2.0, 3.0, 4.0, 5.0]
    b = [1.5, 2.0, 2.5, 4.5, 6.0]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    r = S.icc_oneway(df, "a", "b").first()
    x = np.array([a, b]).T
    n, k = x.shape
    m = x.mean(axis=1)
    msr = k * np.sum((m - x.mean()) ** 2) / (n - 1)
    msw = np.sum((x - m[:, None]) ** 2) / (n * (k - 1))
    assert math.isclose(r.icc, (msr - msw) / (msr + (k - 1) * msw), rel_tol=1e-12)


def test_ensemble_diffs_ratio_null_on_zero(spark):
    ens = spark.createDataFrame(
        [(2, "BE", "inc case", "A", "q0.5", dt.date(2022, 1, 1), m, v)
         for m, v in (("Linear pool", 3.0), ("Quantiles", 0.0), ("Trajectories", 2.0))],
        "round int, location string, target_variable string, scenario_id string, quantile string, "
        "target_end_date date, model string, value double")
    r = S.ensemble_diffs(ens).first()
    assert r.diff_abs == 3.0 and r.diff_rel is None and r.value_trajectories == 2.0


def test_interval_widths_median_both_sides(spark):
    ens = spark.createDataFrame(
        [("BE", "inc case", "Q", q, v) for q, v in (("q0.25", 1.0), ("q0.5", 2.0), ("q0.75", 4.0))],
        "location string, target_variable string, model string, quantile string, value double")
    got = rows(S.interval_widths(ens), "interval", "lower", "upper")
    assert got == [(0.0, 2.0, 2.0), (0.5, 1.0, 4.0)]


def test_global_row_number_is_dense_and_ordered(spark):
    df = spark.range(0, 1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7)
    out = global_row_number(df, [F.col("k")], "rn").collect()
    assert sorted((r.rn, r.k) for r in out) == [(i + 1, i) for i in range(1000)]


def test_ordered_category_unknown_is_null(spark):
    df = spark.createDataFrame([("a",), ("z",)], "lvl string")
    dim = spark.createDataFrame([("a", "Alpha", 1)], "level string, label string, ord int")
    got = rows(S.ordered_category(df, F.col("lvl"), dim), "lvl", "target", "target_order")
    assert got == [("a", "Alpha", 1), ("z", None, None)]


def test_peak_counts_with_zero(spark):
    quiet = _traj(spark, [1.0] * 9).withColumn("sample", F.lit(2))
    both = _traj(spark, [0.0, 1.0, 5.0, 1.0, 0.0, 1.0, 6.0, 1.0, 0.0]).unionByName(quiet)
    q = K.peak_count_quantiles(K.detect_peaks(both), levels=(0.0, 1.0), include_zero=both).first()
    assert (q.q0, q.q1) == (0.0, 2.0)
    q = K.peak_count_quantiles(K.detect_peaks(both), levels=(0.0, 1.0)).first()
    assert (q.q0, q.q1) == (2.0, 2.0)
