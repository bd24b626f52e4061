"""Trajectory scoring, inverse-error weights and weighted ensembles.

* :func:`score_trajectories` — MAE of each trajectory against observed data (E5).
* :func:`trajectory_weights` — inverse-MAE share within each target week (W1).
* :func:`score_intervals` — every score a trajectory ever has on its expanding
  history, with the range of forecast dates it holds for (W5): a trajectory's
  running error sums are computed once in date order; no copy per date.
* :func:`expanding_mae` / :func:`expanding_weights` — report forms with one row per
  forecast date f (scores use only observations strictly before f; E7/W5).
* :func:`weighted_quantile` — weighted Harrell–Davis quantile (E6).
* :func:`weekly_ensembles` — weighted and unweighted ensembles per forecast
  date (E7), from one pass over the positions of both.

Scores meet the rows at trajectory grain as one array over the forecast dates. Rows are copied per date
only behind the last exchange: in the ensembles after each series and week has been dealt
out, in the report after its totals (an aggregate with map-side partial sums) were joined.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from trajens.functions.beta import beta_cdf_jvm, beta_steps
from trajens.functions.dates import weeks_between
from trajens.functions.quantiles import QUANTILE_LEVELS, label
from trajens.operators.ranked import MOST, Late, levels_array, positions, ranked_hits, shuffle_partitions, type7
from trajens.session import materialize

TRAJ = ["location", "target_variable", "model", "sample", "scenario_id"]
WEEK_KEYS = ["target_end_date", "location", "target_variable"]


#: smallest error that an inverse error is taken of, per 100k: a perfect trajectory gets the weight
#: of one that is off by this much, instead of none (or of all weight for a last-bit difference)
MAE_FLOOR = 1e-6
#: errors are taken at this many decimal places, so that float noise does not decide
ERROR_DP = 9


def abs_error() -> Column:
    return F.round(F.abs(F.col("value_100k") - F.col("obs_100k")), ERROR_DP)


def inverse_mae(mae_floor: float | None = MAE_FLOOR) -> Column:
    """1 / max(mae, floor); with floor None, NULL for a perfect trajectory."""
    if mae_floor is None:
        return F.try_divide(F.lit(1.0), F.col("mae"))
    return F.when(F.col("mae").isNotNull(), F.lit(1.0) / F.greatest(F.col("mae"), F.lit(float(mae_floor))))


def score_trajectories(results: DataFrame, truncate_weeks: int = 0,
                       mae_floor: float | None = MAE_FLOOR) -> DataFrame:
    """Per trajectory ``mae``, ``inv_mae = 1/max(mae, mae_floor)`` (with
    ``mae_floor=None``: NULL when mae = 0) and
    ``n_weeks_scored``, on rows with an observation and
    ``target_end_date <= max(target_end_date) - 7*truncate_weeks``."""
    scored = results.where(F.col("obs_100k").isNotNull())
    if truncate_weeks:
        cutoff = results.select(F.date_sub(F.max("target_end_date"), 7 * truncate_weeks)).scalar()
        scored = scored.where(F.col("target_end_date") <= cutoff)
    return (scored.groupBy(*TRAJ)
            .agg(F.avg(abs_error()).alias("mae"), F.count(F.lit(1)).alias("n_weeks_scored"))
            .select(*TRAJ, "mae", inverse_mae(mae_floor).alias("inv_mae"), "n_weeks_scored"))


def _share(df: DataFrame, keys) -> DataFrame:
    """``sum_inv_mae`` per group (NULLs ignored, empty -> 0) and ``weight``."""
    totals = (df.groupBy(*keys)
              .agg(F.coalesce(F.sum("inv_mae"), F.lit(0.0)).alias("sum_inv_mae")))
    return (df.join(totals, list(keys), "inner")
            .withColumn("weight", F.try_divide(F.col("inv_mae"), F.col("sum_inv_mae"))))


def trajectory_weights(results: DataFrame, mae: DataFrame) -> DataFrame:
    """J5 + W1: results with their trajectory's score and inverse-MAE weight."""
    return _share(results.join(mae, TRAJ, "left"), WEEK_KEYS)


def forecast_dates(results: DataFrame):
    """Scalar subquery: sorted distinct target end dates (bounded by the
    calendar span of the projections, not by row count)."""
    return results.select(F.sort_array(F.collect_set("target_end_date"))).scalar()


def mask_at(results: DataFrame, forecast_date) -> DataFrame:
    """Observations at or after ``forecast_date`` (date, string or column)
    hidden (``obs_100k`` NULL) — the data a scorer may see at that date. One
    pass over the rows, no copy."""
    f = forecast_date if isinstance(forecast_date, Column) else F.lit(forecast_date).cast("date")
    return results.withColumn("obs_100k", F.when(F.col("target_end_date") < f, F.col("obs_100k")))


def mask_history(results: DataFrame) -> DataFrame:
    """Report form of :func:`mask_at`: the results once per forecast date."""
    dates = forecast_dates(results)
    return mask_at(results.select("*", F.explode(dates).alias("forecast_date")), F.col("forecast_date"))


def score_intervals(results: DataFrame, min_weeks: int = 0, mae_floor: float | None = MAE_FLOOR) -> DataFrame:
    """Each trajectory's MAE over its observed weeks so far, one row per observed week: the score
    holds for forecast dates f with ``valid_after < f <= valid_until`` (NULL: for good)."""
    per_week = (results.where(F.col("obs_100k").isNotNull())
                .groupBy(*TRAJ, "target_end_date")
                .agg(F.sum(abs_error()).alias("ae"),
                     F.count(F.lit(1)).alias("k")))
    # Running sums inside one trajectory (a trajectory spans at most the
    # projection's weeks, so the window partition is small by construction).
    w = Window.partitionBy(*TRAJ).orderBy("target_end_date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    run = per_week.select(*TRAJ, F.col("target_end_date").alias("valid_after"), F.lead("target_end_date").over(w).alias("valid_until"),
                          F.sum("ae").over(so_far).alias("_ae"), F.sum("k").over(so_far).alias("n_weeks_scored"))
    out = run.select(*TRAJ, "valid_after", "valid_until", (F.col("_ae") / F.col("n_weeks_scored")).alias("mae"), "n_weeks_scored")
    out = out.select(*TRAJ, "valid_after", "valid_until", "mae", inverse_mae(mae_floor).alias("inv_mae"), "n_weeks_scored")
    return out.where(F.col("n_weeks_scored") >= min_weeks) if min_weeks else out


def _holds(f: Column, after: Column, until: Column) -> Column:
    return (f > after) & (until.isNull() | (f <= until))


def expanding_mae(results: DataFrame, min_weeks: int = 0, mae_floor: float | None = MAE_FLOOR) -> DataFrame:
    """Report form of :func:`score_intervals`: one row per forecast date. Trajectories without
    observed weeks before f have no row there (as in a plain score on masked data). Columns:
    forecast_date + A7 columns."""
    held = F.filter("_dates", lambda f: _holds(f, F.col("valid_after"), F.col("valid_until")))
    return (score_intervals(results, min_weeks, mae_floor).withColumn("_dates", forecast_dates(results))
            .select("*", F.explode(held).alias("forecast_date"))
            .select("forecast_date", *TRAJ, "mae", "inv_mae", "n_weeks_scored"))


_SCORE = ("mae", "inv_mae", "n_weeks_scored")


def _dated(at) -> Column:
    """An entry (f, mae, inv_mae, n_weeks_scored) per forecast date of ``_dates``, NULL where no score holds."""
    return F.transform("_dates", lambda f: F.struct(f.alias("f"), *[at(f)[c].alias(c) for c in _SCORE]))


def _with_scores(results: DataFrame, min_weeks: int = 0, mae: DataFrame | None = None) -> DataFrame:
    """``results`` + ``_by``: the trajectory's scores in the order of the forecast dates (bounded by the
    calendar). Joined at trajectory grain."""
    if mae is None:
        spans = score_intervals(results, min_weeks).groupBy(*TRAJ).agg(
            F.collect_list(F.struct("valid_after", "valid_until", *_SCORE)).alias("_iv"))
        at = lambda f: F.get(F.filter("_iv", lambda v: _holds(f, v["valid_after"], v["valid_until"])), 0)
    else:
        spans = mae.groupBy(*TRAJ).agg(F.map_from_entries(F.collect_list(F.struct("forecast_date", F.struct(*_SCORE)))).alias("_iv"))
        at = lambda f: F.try_element_at("_iv", f)
    dates = forecast_dates(results).alias("_dates")
    scores = spans.select("*", dates).select(*TRAJ, _dated(at).alias("_by"))
    blank = F.transform("_dates", lambda f: F.struct(f.alias("f"), F.lit(None).cast("double").alias("mae"),
                                                     F.lit(None).cast("double").alias("inv_mae"), F.lit(None).cast("long").alias("n_weeks_scored")))
    joined = results.join(scores, TRAJ, "left").select(*results.columns, "_by", dates)
    return joined.select(*results.columns, F.coalesce("_by", blank).alias("_by"))


def expanding_weights(results: DataFrame, min_horizon: int | None = None,
                      mae: DataFrame | None = None, min_weeks: int = 0) -> DataFrame:
    """E7 ``weights``: every results row once per forecast date f, with its
    trajectory's expanding score at f (NULL before ``min_weeks`` of history) and
    the inverse-MAE weight per (f, target week). ``min_horizon`` keeps only weeks
    ``>= f + 7*h`` (the report uses h = 0).

    The rows with their scores are stored once; the totals of a series and week come as one array over
    the forecast dates, joined on (series, week), and only then are the rows copied per date."""
    # dealt into all shuffle partitions: each row becomes one per date when it is read again
    scored = _with_scores(results, min_weeks, mae).repartition(shuffle_partitions(results.sparkSession), *WEEK_KEYS)
    rows = materialize(scored, "scored-rows")
    kept = lambda e: F.lit(True) if min_horizon is None else F.col("target_end_date") >= F.date_add(e["f"], 7 * min_horizon)
    sums = (rows.select(*WEEK_KEYS, F.explode(F.filter("_by", kept)).alias("e"))
            .groupBy(*WEEK_KEYS, "e.f").agg(F.coalesce(F.sum("e.inv_mae"), F.lit(0.0)).alias("s"))
            .groupBy(*WEEK_KEYS).agg(F.map_from_entries(F.collect_list(F.struct("f", "s"))).alias("_m"))
            .select("*", forecast_dates(results).alias("_dates"))
            .select(*WEEK_KEYS, F.transform("_dates", lambda f: F.try_element_at("_m", f)).alias("_sums")))
    totals = F.transform("_by", lambda e, i: F.struct(*[e[c].alias(c) for c in ("f", *_SCORE)], F.get("_sums", i).alias("t")))
    return (rows.join(sums, WEEK_KEYS).select("*", F.explode(F.filter(totals, kept)).alias("_e"))
            .select(*results.columns, F.col("_e.f").alias("forecast_date"), "_e.mae", "_e.inv_mae", "_e.n_weeks_scored",
                    F.col("_e.t").alias("sum_inv_mae"), F.try_divide(F.col("_e.inv_mae"), F.col("_e.t")).alias("weight")))


#: a beta probability below exp(-_TAIL) counts as 0, one that close to 1 as 1
_TAIL = 30.0


def _weighted_hits(levels) -> Column:
    """Of a position, the levels that its step adds to, as structs of level, label, the values ``a``
    and ``b`` of its beta distribution, the weight share ``c`` where I_c(a, b) must be taken (else NULL)
    and ``top``: the value from which on all steps count whole (else NULL).

    A beta(a, b) variable with mean p is within sqrt(T / (2 (a+b+1))) of p but for a probability of
    2 exp(-T) (it is sub-Gaussian with variance factor 1 / (4 (a+b+1))): steps further below add
    nothing, steps further above add all of themselves, so that only the first of these is needed."""
    ok = (F.col("_bad") == 0) & (F.col("_sw") > 0)
    last = F.col("_nx").isNull()
    nw1 = F.col("_sw") * F.col("_sw") / F.col("_sw2") + 1.0
    # one-element array: these are computed once per position, not per level
    facts = F.array(F.struct(
        F.when(last, 1.0).otherwise(F.least(F.col("_cw") / F.col("_sw"), F.lit(1.0))).alias("c"),
        (F.col("_pw") / F.col("_sw") - 1e-12).alias("before"), nw1.alias("n"),
        F.sqrt((_TAIL + 0.7) / (2.0 * (nw1 + 1.0))).alias("t")))

    def of(e: Column) -> Column:
        whole = lambda c, p: (c >= 1.0) | (c - p > e["t"])
        needed = F.filter(levels_array(levels), lambda lv: F.when(whole(e["c"], lv["p"]), ~whole(e["before"], lv["p"]))
                          .otherwise(lv["p"] - e["c"] <= e["t"]))
        return F.transform(needed, lambda lv: F.struct(
            lv["p"].alias("p"), lv["q"].alias("q"), (e["n"] * lv["p"]).alias("a"), (e["n"] * (1.0 - lv["p"])).alias("b"),
            F.when(~whole(e["c"], lv["p"]), e["c"]).alias("c"), F.when(whole(e["c"], lv["p"]), F.col("_x")).alias("top")))

    nothing = F.transform(levels_array(levels), lambda lv: F.struct(
        lv["p"].alias("p"), lv["q"].alias("q"), *[F.lit(None).cast("double").alias(c) for c in ("a", "b", "c", "top")]))
    none = F.filter(nothing, lambda _: F.lit(False))
    # a group that yields NULL needs only its last row
    return F.when(ok, F.flatten(F.transform(facts, of))).when(last, nothing).otherwise(none)


def _beta(c: Column, a: Column, b: Column) -> Column:
    """I_c(a, b) where c isn't NULL, without the call where Chernoff's bound settles it: the smaller
    tail is at most exp(-(a+b) KL(p, c))."""
    n = a + b
    p = a / n
    far = n * (p * F.log(c / p) + (1.0 - p) * F.log((1.0 - c) / (1.0 - p))) < -_TAIL
    settled = F.when(c <= 0, 0.0).when(c >= 1, 1.0).when(far, F.when(c > p, 1.0).otherwise(0.0))
    return F.coalesce(settled, F.when(c.isNotNull() & settled.isNull(), beta_cdf_jvm(c, a, b)))


def _steps(levels) -> Column:
    """Of a position, one array: per level what its step adds, then per level the value from which on
    all steps count whole (infinite where that isn't this position's)."""
    levels = [float(p) for p in levels]

    @arrow_udf("array<double>")
    def steps(x: pa.Array, nx: pa.Array, share: pa.Array, before: pa.Array, size: pa.Array) -> pa.Array:
        x, nx, share, before, size = (a.to_numpy(zero_copy_only=False) for a in (x, nx, share, before, size))
        last = np.isnan(nx)  # NULL: there is no next value
        value, first = beta_steps(share, before, last, size, levels, _TAIL)
        out = np.concatenate([value * np.where(last, 0.0, nx - x)[:, None], np.where(first, x[:, None], np.inf)], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))

    ok = (F.col("_bad") == 0) & (F.col("_sw") > 0)
    size = F.when(ok, F.col("_sw") * F.col("_sw") / F.col("_sw2") + 1.0).otherwise(2.0)
    share = lambda c: F.when(ok, F.col(c) / F.col("_sw")).otherwise(0.0)
    return steps("_x", "_nx", share("_cw"), share("_pw"), size)


def _in_batches(pos: DataFrame, group, levels, kinds) -> DataFrame:
    """group, ``_v``: array of (kind, p, q, value). One row per position through Arrow, summed per
    group by plain aggregates."""
    m, aggs, made = len(levels), [], []
    if "weighted" in kinds:
        pos = pos.withColumn("_st", _steps(levels))
        aggs += [F.sum(F.get("_st", F.lit(i))).alias(f"_t{i}") for i in range(m)]
        aggs += [F.min(F.get("_st", F.lit(m + i))).alias(f"_top{i}") for i in range(m)]
        aggs += [F.max("_bad").alias("_bad"), F.max("_sw").alias("_sw")]
        ok = (F.col("_bad") == 0) & (F.col("_sw") > 0)
        made += [("weighted", p, F.when(ok, F.col(f"_top{i}") - F.col(f"_t{i}"))) for i, p in enumerate(levels)]
    if "unweighted" in kinds:
        n1 = (F.col("_n") - 1).cast("double")
        for i, p in enumerate(levels):
            rank = F.floor(F.lit(float(p)) * n1)
            hit = (rank < F.col("_rank")) & (rank >= F.col("_rank") - F.col("_k"))
            aggs.append(F.max(F.when(hit, type7(F.lit(float(p))))).alias(f"_u{i}"))
            made.append(("unweighted", p, F.col(f"_u{i}")))
    entry = lambda kind, p, v: F.struct(F.lit(kind).alias("kind"), F.lit(float(p)).alias("p"), F.lit(label(p)).alias("q"), v.alias("value"))
    return pos.groupBy(*group).agg(*aggs).select(*group, F.array(*[entry(*e) for e in made]).alias("_v"))


def group_ensembles(df: DataFrame, keys, value: str = "value_100k", weight: str | None = "weight", levels=QUANTILE_LEVELS,
                    kinds: Sequence[str] = ("weighted", "unweighted"), jvm_beta: bool = False, most: int = MOST,
                    late: Late | None = None) -> DataFrame:
    """Weighted (E6) and type-7 quantiles of the same groups from one pass: keys, ``kind``,
    quantile_level, quantile, value. See :func:`weighted_quantile`."""
    pos, group, out = positions(df, keys, value, weight, most, late)
    names = [*keys, *(late.names if late else ())]
    if not jvm_beta:
        return (_in_batches(pos, group, levels, kinds).select(*out, "_v").select(*names, F.explode("_v").alias("v"))
                .select(*names, F.col("v.kind").alias("kind"), F.col("v.p").alias("quantile_level"),
                        F.col("v.q").alias("quantile"), F.col("v.value").alias("value")))
    parts = []
    if "weighted" in kinds:
        parts.append(F.transform(_weighted_hits(levels), lambda e: F.struct(
            F.lit("weighted").alias("kind"), e["p"].alias("p"), e["q"].alias("q"), e["a"].alias("a"), e["b"].alias("b"),
            e["c"].alias("c"), e["top"].alias("top"))))
    if "unweighted" in kinds:
        no = F.lit(None).cast("double")
        parts.append(F.transform(ranked_hits(levels), lambda e: F.struct(
            F.lit("unweighted").alias("kind"), e["p"].alias("p"), e["q"].alias("q"), no.alias("a"), no.alias("b"), no.alias("c"),
            e["value"].alias("top"))))
    hits = pos.select(*group, (F.col("_nx") - F.col("_x")).alias("_dx"), F.explode(F.concat(*parts)).alias("lv"))
    step = _beta(F.col("lv.c"), F.col("lv.a"), F.col("lv.b")) * F.col("_dx")
    return (hits.select(*group, F.col("lv.kind").alias("kind"), F.col("lv.p").alias("quantile_level"),
                        F.col("lv.q").alias("quantile"), F.col("lv.top").alias("_top"), step.alias("_t"))
            .groupBy(*group, "kind", "quantile_level", "quantile")
            .agg((F.min("_top") - F.coalesce(F.sum("_t"), F.lit(0.0))).alias("value"))
            .select(*out, "kind", "quantile_level", "quantile", "value")
            .select(*names, "kind", "quantile_level", "quantile", "value"))


def weighted_quantile(df: DataFrame, keys, value: str = "value_100k", weight: str = "weight",
                      levels=QUANTILE_LEVELS, jvm_beta: bool = False, most: int = MOST) -> DataFrame:
    """Weighted Harrell–Davis quantiles per group.

    With values sorted ascending, normalised cumulative weights c_i (c_0 = 0,
    c_n = 1), Kish size nw = (Σw)²/Σw², a = (nw+1)p, b = (nw+1)(1-p):
    q_p = Σ x_i [I_{c_i}(a,b) - I_{c_{i-1}}(a,b)]. Summed by parts up to the first value x_j from
    which on every I is 1, this is q_p = x_j - Σ_{i<j} I_{c_i}(a,b) (x_{i+1} - x_i); where I is 0
    (to within exp(-30)) a step adds nothing. So a level reads only the positions around it, and
    the incomplete beta is taken only there. A group with any NULL weight (or zero total)
    yields NULL, as NA propagates in the reference.

    Running weights come from :func:`trajens.operators.ranked.positions` (no large group in one task;
    equal values are one row, which is exact, since steps between equal values add nothing); the
    per-level sums are a plain aggregate with map-side partial sums. The beta is evaluated for a batch
    of positions and all levels at once (NumPy over Arrow); ``jvm_beta`` takes it per row in the JVM."""
    return group_ensembles(df, keys, value, weight, levels, ("weighted",), jvm_beta, most).drop("kind")


WEEKLY_KEYS = ["forecast_date", "location", "target_variable", "target_end_date", "n_weeks_scored"]


def weekly_ensembles(results: DataFrame, levels=QUANTILE_LEVELS, min_horizon: int | None = 0,
                     weights: DataFrame | None = None, include_weighted: bool = True,
                     include_unweighted: bool = True, min_weeks: int = 0, most: int = MOST // 4, after=None) -> DataFrame:
    """E7 ``ensembles``: for each forecast date, a weighted (Harrell–Davis,
    inverse-MAE) and an unweighted (type 7) quantile ensemble per
    (location, target, week, weeks of history), scenarios and models pooled.
    Missing history (or less than ``min_weeks``) -> ``n_weeks_scored = 0``; ``horizon = (week - f) / 7``.

    Weighted quantiles don't depend on the weights' scale, so inverse errors serve as weights and no
    group total is joined. ``most`` bounds the trajectories of a series and week that one task copies
    per date. ``weights``: rows per forecast date (as of :func:`expanding_weights`), if already made.
    ``after`` (a date): only forecast dates after it, from the rows that these read."""
    kinds = [k for k, on in (("weighted", include_weighted), ("unweighted", include_unweighted)) if on]
    if weights is not None:
        if after is not None:
            weights = weights.where(F.col("forecast_date") > F.lit(after))
        out = group_ensembles(weights, WEEKLY_KEYS, "value_100k", "weight", levels, kinds)
    else:
        cols = ["value_100k", *dict.fromkeys([*TRAJ, *WEEK_KEYS, "obs_100k"])]
        scored = _with_scores(results.select(*cols), min_weeks)
        kept = lambda e: F.lit(True) if min_horizon is None else F.col("target_end_date") >= F.date_add(e["f"], 7 * min_horizon)
        wanted = kept if after is None else lambda e: kept(e) & (e["f"] > F.lit(after))
        if after is not None and min_horizon is not None:
            scored = scored.where(F.col("target_end_date") > F.date_add(F.lit(after), 7 * min_horizon))
        lean = F.transform(F.filter("_by", wanted), lambda e: F.struct(e["f"].alias("f"), e["inv_mae"].alias("w"), e["n_weeks_scored"].alias("n")))
        # stored: group sizes are counted before the rows are dealt out
        rows = materialize(scored.select(*WEEK_KEYS, "value_100k", lean.alias("_by")), "dated-rows")

        def expand(by: Column, _: Column) -> Column:
            return F.transform(by, lambda e: F.struct(
                F.struct(e["f"].alias("forecast_date"), e["n"].alias("n_weeks_scored")).alias("h"), e["w"].alias("w")))

        late = Late(("forecast_date", "n_weeks_scored"), "_by", expand)
        out = group_ensembles(rows, WEEK_KEYS, "value_100k", None, levels, kinds, most=most, late=late)
    weighted = F.col("kind") == "weighted"
    return (out.withColumn("model", F.when(weighted, "Trajectories").otherwise("Trajectories unweighted"))
            .withColumn("scenario_id", F.when(weighted, "Weighted").otherwise("Unweighted"))
            .withColumn("n_weeks_scored", F.coalesce(F.col("n_weeks_scored"), F.lit(0)))
            .withColumn("horizon", weeks_between("target_end_date", "forecast_date"))
            .select(*WEEKLY_KEYS, "quantile_level", "quantile", "value", "model", "scenario_id", "horizon"))
