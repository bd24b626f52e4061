"""Forecast evaluation: score inputs, weighted interval score, pairwise skill
and skill summaries (E8–E10, E21).

WIS: for a forecast holding all symmetric levels, the mean over levels of the
quantile (pinball) score ``2 * (1{y <= q} - p) * (q - y)`` equals the mean of
the α/2-weighted interval scores as the scoring package reports it per
quantile row; :func:`interval_scores` also returns the interval form
(dispersion, over- and under-prediction).

Pairwise skill: each pair of models is compared on the forecast units that
both have (their own overlap, whatever third models lack); the ratio is that
of the two mean scores there, a model's relative skill the geometric mean of
its ratios against every model it overlaps with (itself included), scaled
by the baseline's. Scores are summarised before, so pairs are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajens.functions.quantiles import interval_of, side_of


def _null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join on ``keys`` matching NULL to NULL (dplyr's default)."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    joined = left.join(r, cond, how)
    if how == "full":
        for k in keys:
            joined = joined.withColumn(k, F.coalesce(F.col(k), F.col(f"_r_{k}")))
    return joined.drop(*[f"_r_{k}" for k in keys])


def score_input(ensembles: DataFrame, results: DataFrame, forecast_date, cutoff) -> DataFrame:
    """Ensemble quantiles as forecasts with the observed value (per target
    label and week), numeric quantile level, fixed forecast date; rows after
    ``cutoff`` and rows without a model are dropped. ``forecast_date`` and
    ``cutoff``: a date, its text, or a column."""
    forecast_date, cutoff = (d if isinstance(d, Column) else F.lit(d).cast("date") for d in (forecast_date, cutoff))
    obs = results.select("target_end_date", "target", "obs_100k").distinct()
    f = (ensembles.drop("round", "target_variable", "location", "quantile_level")
         .withColumn("quantile", F.regexp_replace("quantile", "^q", "").cast("double"))
         .withColumn("forecast_date", forecast_date))
    return (_null_safe_join(f, obs, ["target_end_date", "target"])
            .withColumnRenamed("value", "prediction")
            .withColumnRenamed("obs_100k", "true_value")
            .where((F.col("target_end_date") <= cutoff) & F.col("model").isNotNull()))


def log_scale(forecasts: DataFrame, offset: float = 1e-5) -> DataFrame:
    """``log(y + 1e-5)``, ``log(max(pred, 0) + 1e-5)`` with NULL kept NULL."""
    pred = F.col("prediction")
    return (forecasts
            .withColumn("true_value", F.log(F.col("true_value") + offset))
            .withColumn("prediction", F.when(pred.isNotNull(),
                                             F.log(F.greatest(pred, F.lit(0.0)) + offset))))


def quantile_score(level="quantile") -> Column:
    y, q, p = F.col("true_value"), F.col("prediction"), F.col(level)
    return F.lit(2.0) * ((y <= q).cast("double") - p) * (q - y)


def wis(forecasts: DataFrame, by, level: str = "quantile", log: bool = True) -> DataFrame:
    """Mean weighted interval score per ``by`` group (NULL scores dropped)."""
    f = log_scale(forecasts) if log else forecasts
    return (f.withColumn("_s", quantile_score(level))
            .groupBy(*by).agg(F.avg("_s").alias("interval_score")))


def interval_scores(forecasts: DataFrame, unit, level: str = "quantile", log: bool = True) -> DataFrame:
    """Interval form per forecast unit and central interval: the median counts
    as both bounds of interval 0; weighted by α/2 with α = 1 - interval."""
    f = log_scale(forecasts) if log else forecasts
    f = f.withColumn("interval", interval_of(level)).withColumn("_side", side_of(level))
    med = f.where(F.col(level) == 0.5).withColumn("_side", F.lit("upper"))
    both = f.unionByName(med)
    g = (both.groupBy(*unit, "interval")
         .agg(F.max(F.when(F.col("_side") == "lower", F.col("prediction"))).alias("lower"),
              F.max(F.when(F.col("_side") == "upper", F.col("prediction"))).alias("upper"),
              F.max("true_value").alias("y")))
    alpha = F.lit(1.0) - F.col("interval")
    disp = alpha / 2 * (F.col("upper") - F.col("lower"))
    # greatest() skips NULL: an unknown truth or bound must stay unknown, not count as a hit
    known = F.col("y").isNotNull()
    over = F.when(known & F.col("lower").isNotNull(), F.greatest(F.col("lower") - F.col("y"), F.lit(0.0)))
    under = F.when(known & F.col("upper").isNotNull(), F.greatest(F.col("y") - F.col("upper"), F.lit(0.0)))
    return (g.select(*unit, "interval", disp.alias("dispersion"), over.alias("overprediction"),
                     under.alias("underprediction"))
            .withColumn("interval_score",
                        F.col("dispersion") + F.col("overprediction") + F.col("underprediction")))


def wis_of_pairs(forecasts: DataFrame, unit, by, level: str = "quantile", log: bool = True) -> DataFrame:
    """E8 where levels may be missing: mean weighted interval score per ``by`` group from the interval
    form. Per forecast unit (``unit``: the columns that name one, ``by`` among them) each level is matched with
    its mirror image; an interval counts with its weight α/2 and for both of its levels, the median
    once, and a level whose partner (or value, or truth) is missing counts nowhere. Also ``levels``
    (levels counted) and ``incomplete_units`` (units with a level left out or without a median). On complete
    symmetric levels this equals :func:`wis`."""
    unit = list(unit)
    known = forecasts.where(F.col(level).isNotNull())
    pairs = interval_scores(known, unit, level, log)
    scored = pairs.select(*unit, "interval", F.col("interval_score").alias("_s"),
                          F.when(F.col("interval_score").isNull(), 0).when(F.col("interval") == 0, 1).otherwise(2).alias("_n"))
    per_unit = scored.groupBy(*unit).agg(
        F.sum(F.col("_s") * F.col("_n")).alias("_sum"), F.sum("_n").alias("_n"),
        (F.max((F.col("_n") == 0).cast("int")) + 1 - F.max((F.col("interval") == 0).cast("int"))).alias("_gaps"))
    return (per_unit.groupBy(*by)
            .agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias("interval_score"), F.sum("_n").alias("levels"),
                 F.count(F.when(F.col("_gaps") > 0, 1)).alias("incomplete_units")))


def pairwise_skill(scores: DataFrame, by, baseline: str, metric: str = "interval_score",
                   model: str = "model") -> DataFrame:
    """Each model against ``baseline`` within ``by`` groups:
    ``mean_scores_ratio``, ``relative_skill`` (geometric-mean form) and
    ``scaled_rel_skill`` (relative to the baseline's).

    ``scores`` is an already summarised score table (a few rows per model
    and group); the group windows below hold one row per model (and unit)."""
    by = list(by)
    units = [c for c in scores.columns if c not in set(by) | {model, metric}]
    s = scores.where(F.col(metric).isNotNull()).groupBy(*by, *units, model).agg(F.avg(metric).alias("_s"))
    # group keys travel as structs: NULL equals NULL in them, as in grouping
    left = s.select(F.struct(F.lit(1), *by, *units).alias("_u"), *by, F.col(model).alias("_i"), F.col("_s").alias("_si"))
    right = s.select(F.struct(F.lit(1), *by, *units).alias("_u"), F.col(model).alias("_j"), F.col("_s").alias("_sj"))
    # models x models rows per unit: the score table has one row per model and unit
    ratios = (left.join(right, "_u").groupBy(*by, "_i", "_j")
              .agg(F.try_divide(F.avg("_si"), F.avg("_sj")).alias("_r")))
    skill = F.exp(F.avg(F.when(F.col("_r") > 0, F.log("_r"))).over(Window.partitionBy(*by, "_i")))
    rel = ratios.withColumn("relative_skill", skill)
    base = F.max(F.when((F.col("_i") == baseline), F.col("relative_skill"))).over(Window.partitionBy(*by))
    out = (rel.withColumn("_b", base).where((F.col("_j") == baseline))
           .withColumn("scaled_rel_skill", F.try_divide(F.col("relative_skill"), F.col("_b"))))
    return out.select(F.col("_i").alias(model), F.lit(baseline).alias("compare_against"), *by,
                      F.col("_r").alias("mean_scores_ratio"), "relative_skill", "scaled_rel_skill")


def static_rel_wis(pairwise: DataFrame, baseline: str, model: str = "model") -> DataFrame:
    """Relative WIS against the baseline without the baseline's own row."""
    keep = [c for c in pairwise.columns if c not in ("compare_against", "mean_scores_ratio", "relative_skill",
                                                     "scaled_rel_skill")]
    return (pairwise.where((F.col("compare_against") == baseline) & (F.col(model) != baseline))
            .select(*keep, F.col("scaled_rel_skill").alias("rel_wis")))


def rel_wis(pairwise: DataFrame, label_week: int = 31) -> DataFrame:
    """Rows against the baseline renamed ``rel_wis``; label only at ``label_week``."""
    return (pairwise.select("model", "n_weeks_scored", "target",
                            F.col("scaled_rel_skill").alias("rel_wis"))
            .withColumn("target_label", F.when(F.col("n_weeks_scored") == label_week,
                                               F.col("target"))))


def rel_wis_at_weeks(rw: DataFrame, weeks=(4, 8, 16, 31)) -> DataFrame:
    """Median relative WIS at chosen weeks of data."""
    return (rw.where(F.col("n_weeks_scored").isin(list(weeks)))
            .groupBy("n_weeks_scored").agg(F.median("rel_wis").alias("median")))


def rel_wis_wide(rw: DataFrame, weeks=(4, 8, 16, 31)) -> DataFrame:
    """One column per chosen week of data (``weeks_4`` ...)."""
    return (rw.where(F.col("n_weeks_scored").isin(list(weeks)))
            .groupBy("model", "target")
            .pivot("n_weeks_scored", list(weeks)).agg(F.first("rel_wis"))
            .withColumnsRenamed({str(w): f"weeks_{w}" for w in weeks}))


def six_number_summary(rw: DataFrame, value: str = "rel_wis", by: str = "target") -> DataFrame:
    """Min, quartiles (type 7), mean, max — per ``by`` and overall (NULL
    ``by``) in one grouping-sets aggregate. Input is the relative-skill table
    (one row per target and weeks of data), already summarised."""
    q = F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = rw.rollup(by).agg(F.min(value).alias("min"), q.alias("_q"), F.avg(value).alias("mean"),
                          F.max(value).alias("max"), F.grouping(by).alias("overall"))
    return g.select(by, "overall", "min", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                    "mean", F.col("_q")[2].alias("q3"), "max")


def boxplot_stats(rw: DataFrame, value: str = "rel_wis", by: str = "target") -> DataFrame:
    """Hinges (type 7 quartiles), whiskers at the most extreme values
    within 1.5·IQR of the hinges, and the number of outliers, per group."""
    q = F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    h = rw.groupBy(by).agg(q.alias("_q"))
    h = h.select(by, F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("middle"),
                 F.col("_q")[2].alias("upper"))
    iqr = F.col("upper") - F.col("lower")
    lo_f, hi_f = F.col("lower") - 1.5 * iqr, F.col("upper") + 1.5 * iqr
    v = F.col(value)
    inside = (v >= lo_f) & (v <= hi_f)
    return (_null_safe_join(rw, h, [by])
            .groupBy(by, "lower", "middle", "upper")
            .agg(F.min(F.when(inside, v)).alias("ymin"), F.max(F.when(inside, v)).alias("ymax"),
                 F.count(F.when(~inside, 1)).alias("n_outliers")))


def boxplot_outliers(rw: DataFrame, value: str = "rel_wis", by: str = "target") -> DataFrame:
    """The rows beyond the whiskers, with the hinge distance they exceed."""
    h = boxplot_stats(rw, value, by).select(F.col(by).alias("_by"), "ymin", "ymax")
    v = F.col(value)
    return (rw.join(h, F.col(by).eqNullSafe(F.col("_by"))).where((v < F.col("ymin")) | (v > F.col("ymax")))
            .drop("_by", "ymin", "ymax"))
