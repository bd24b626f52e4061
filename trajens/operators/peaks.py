"""Peak detection and peak summaries.

A row is a peak when its value is strictly greater than every other value in
the centred window of ``span`` rows of its trajectory (time order); rows
without a full window (the first/last ``span // 2``) and windows holding NULLs
are never peaks. Windows are partitioned by trajectory, whose length is
bounded by the projection horizon, so no partition grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PEAK_KEYS = ["sample", "model", "scenario_id", "location", "target_variable"]


def flag_peaks(df: DataFrame, span: int = 5, keys=PEAK_KEYS, order: str = "target_end_date",
               value: str = "value") -> DataFrame:
    """All rows with a boolean ``peak`` column."""
    h = span // 2
    w = Window.partitionBy(*keys).orderBy(order)
    left = w.rowsBetween(-h, -1)
    right = w.rowsBetween(1, h)
    v = F.col(value)
    full = (F.count(v).over(left) == h) & (F.count(v).over(right) == h)
    peak = (v.isNotNull() & full & (v > F.max(v).over(left)) & (v > F.max(v).over(right)))
    return df.withColumn("peak", F.coalesce(peak, F.lit(False)))


def detect_peaks(df: DataFrame, span: int = 5, keys=PEAK_KEYS, order: str = "target_end_date",
                 value: str = "value") -> DataFrame:
    """The peak rows only (``peak`` = true)."""
    return flag_peaks(df, span, keys, order, value).where(F.col("peak"))


def peaks_per_trajectory(peaks: DataFrame, keys=PEAK_KEYS) -> DataFrame:
    """Number of peaks per trajectory (trajectories without a peak are absent)."""
    return peaks.groupBy(*keys).agg(F.count(F.lit(1)).alias("peaks"))


def peak_count_quantiles(peaks: DataFrame, levels=(0.05, 0.5, 0.95),
                         by=("model", "scenario_id", "location", "target_variable"),
                         include_zero: DataFrame | None = None) -> DataFrame:
    """Half-even rounded quantiles of the peak count per group, one
    column per level (``q0_05``, ``q0_5``, ``q0_95``). ``percentile`` keeps a
    value->count map per group; peak counts are small integers (at most
    half a trajectory's weeks), so that map stays tiny however many
    trajectories a group holds. ``include_zero``: the rows the peaks were
    sought in; their trajectories without a peak then count as 0 (the
    default leaves them out)."""
    counts = peaks_per_trajectory(peaks)
    if include_zero is not None:
        every = include_zero.select(*PEAK_KEYS).distinct()
        counts = every.join(counts, PEAK_KEYS, "left").fillna(0, ["peaks"])
    qs = F.percentile(F.col("peaks"), F.array(*[F.lit(float(p)) for p in levels]))
    g = counts.groupBy(*by).agg(qs.alias("_q"))
    cols = [F.bround(F.col("_q")[i], 0).alias("q" + f"{p:g}".replace(".", "_"))
            for i, p in enumerate(levels)]
    return g.select(*by, *cols)


def alltime_peak(truth: DataFrame) -> DataFrame:
    """Observed weeks at each series' maximum (ties kept — compared at
    9 dp, since float sums of the same days differ in the last bits between
    runs and engines), per 100k."""
    v9 = F.round(F.col("value"), 9)
    mx = truth.groupBy("location", "target_variable").agg(F.max(v9).alias("_mx"))
    return (truth.join(mx, ["location", "target_variable"])
            .where(v9 == F.col("_mx"))
            .select("location", "target_variable",
                    (F.try_divide(F.col("value"), F.col("population")) * 100000.0)
                    .alias("value_100k_alltime")))


def peak_sizes(peaks: DataFrame, truth: DataFrame) -> DataFrame:
    """Peaks with the all-time observed peak of their series."""
    return peaks.join(alltime_peak(truth), ["location", "target_variable"], "left")
