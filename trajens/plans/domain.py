"""Domain tables for a test-data directory, built lazily from the adapter.

Each builder returns a fresh lazy DataFrame; Catalyst sees the whole chain
from parquet scans to the final operator, so pruning and pushdown reach the
scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajens.operators import prepare as P
from trajens.session import materialize
from trajens.sources import testdata as T


def observed(spark: SparkSession, sf_dir: str, level: str = "region") -> DataFrame:
    """Weekly truth with population, built once per query: one row per series
    and week, so it is written to the shared folder, and every join against
    it (observations, populations, peak sizes) finds a file of known size.
    Below the session's broadcast threshold Spark plans a broadcast from the
    start and the projections are never shuffled on series keys; above it,
    an ordinary join."""
    daily = T.truth_daily(spark, sf_dir, level)
    return materialize(P.weekly_truth(daily, T.population(spark, sf_dir, level)), "weekly-truth")


def results(spark: SparkSession, sf_dir: str, level: str = "region",
            n_model_min: int = 3, obs: DataFrame | None = None) -> DataFrame:
    """The cleaned results table."""
    # rows and model counts both read the submissions: aggregated from the line items once
    raw = materialize(T.projections_raw(spark, sf_dir, level), "raw")
    obs = observed(spark, sf_dir, level) if obs is None else obs
    return P.prepare_projections(raw, obs, T.rounds(spark, sf_dir), round_=T.ROUND, n_model_min=n_model_min)


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results for queries that read them more than once (scores and rows,
    forecast dates, several ensembles): one build, written once, whatever
    columns each reader needs."""
    return materialize(results(spark, sf_dir), "results")


def with_target(df: DataFrame, dim: DataFrame, name: str = "target") -> DataFrame:
    """Ordered-category label of ``location || ' ' || target_variable``
    (unknown level -> NULL label and order)."""
    from trajens.operators.shape import ordered_category
    return ordered_category(df, F.concat_ws(" ", "location", "target_variable"), dim, name)


def forecast_date(spark: SparkSession, sf_dir: str):
    """Day before the round's origin: the date of the static ensembles."""
    return F.date_sub(T.origin(spark, sf_dir), 1)


def score_cutoff(spark: SparkSession, sf_dir: str):
    """Last day with data."""
    return T.last_date(spark, sf_dir)


def results_t(spark: SparkSession, sf_dir: str, res: DataFrame | None = None) -> DataFrame:
    return with_target(stored_results(spark, sf_dir) if res is None else res, T.target_dim(spark, sf_dir))


def ensembles_all(spark: SparkSession, sf_dir: str, res: DataFrame | None = None) -> DataFrame:
    """E3 ∪ E4: quantile, trajectory and linear-pool ensembles with target labels.
    Model quantiles are written once and feed both the quantile ensemble
    and the linear pool."""
    from trajens.operators import quantiles as Q
    from trajens.operators.linear_pool import linear_pool
    res = stored_results(spark, sf_dir) if res is None else res
    mq = materialize(Q.model_quantiles(res), "model-quantiles")
    parts = Q.union_all(Q.ensemble_quantiles(mq), Q.ensemble_trajectories(res), linear_pool(mq))
    return with_target(parts, T.target_dim(spark, sf_dir))


def weekly(spark: SparkSession, sf_dir: str, res: DataFrame | None = None) -> DataFrame:
    """E7 ensembles (horizon >= 0) with target labels."""
    from trajens.operators.weighting import weekly_ensembles
    res = stored_results(spark, sf_dir) if res is None else res
    # written once: its readers prune differently, and bounds and rows must come from one result
    return materialize(with_target(weekly_ensembles(res), T.target_dim(spark, sf_dir)), "weekly")


def weekly_with_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly ensembles (horizon >= 0, weighting label) full-joined
    with observations on (target, week)."""
    from trajens.operators.shape import weekly_with_obs as wwo
    res = stored_results(spark, sf_dir)
    return wwo(weekly(spark, sf_dir, res), results_t(spark, sf_dir, res))


def weekly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8 on weekly ensembles: mean WIS (log scale) per (model = weighting
    scheme, weeks of data, target), forecasts after the cutoff dropped."""
    from trajens.operators import evaluation as E
    w = weekly_with_obs(spark, sf_dir)
    f = (w.select(F.col("scenario_id").alias("model"), "n_weeks_scored", "target",
                  "target_end_date",
                  F.regexp_replace("quantile", "^q", "").cast("double").alias("quantile"),
                  F.col("value").alias("prediction"), F.col("obs_100k").alias("true_value"))
         .where((F.col("target_end_date") <= score_cutoff(spark, sf_dir))
                & F.col("model").isNotNull()))
    return E.wis(f, ["model", "n_weeks_scored", "target"])


def weighted_date(res: DataFrame):
    """Forecast date of the weighted facet: the latest week with an observation."""
    return res.where(F.col("obs").isNotNull()).select(F.max("target_end_date")).scalar()


def rel_wis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E10 on weekly scores: weighted against unweighted, per (weeks of data,
    target), as ``rel_wis`` with a label at week 31."""
    from trajens.operators import evaluation as E
    pw = E.pairwise_skill(weekly_scores(spark, sf_dir), ["n_weeks_scored", "target"], "Unweighted")
    return E.rel_wis(pw.where(F.col("model") == "Weighted"))
