"""Truth rollup and projection preparation (load → clean → join → scale).

All joins name their keys; dimension-sized sides (population, rounds, truth)
are left to Spark's size-checked broadcast rule rather than forced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajens.functions.dates import epi_week, epi_year, horizon_end_date, parse_horizon

TRAJ_KEYS = ["location", "target_variable", "model", "sample", "scenario_id"]
SUM_DP = 9
TARGET_KEYS = ["round", "location", "target_variable", "target_end_date", "scenario_id"]


def tag_target(daily: DataFrame, target_variable: str) -> DataFrame:
    """Literal target tag on one observation source."""
    return daily.withColumn("target_variable", F.lit(target_variable))


def union_truth(*tagged: DataFrame) -> DataFrame:
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def weekly_truth(daily: DataFrame, pop: DataFrame) -> DataFrame:
    """Roll daily observations up to epi weeks (week ends at its last
    observed day), sum with NULLs ignored (all-NULL week -> 0), attach
    population, tag ``model = "Observed"``. Sums are snapped at ``SUM_DP``
    decimal places: the order in which tasks add floats must not show."""
    weekly = (daily
              .withColumn("epi_year", epi_year("date"))
              .withColumn("epi_week", epi_week("date"))
              .groupBy("location", "location_name", "target_variable", "epi_year", "epi_week")
              .agg(F.max("date").alias("target_end_date"),
                   F.round(F.coalesce(F.sum("value"), F.lit(0.0)), SUM_DP).alias("value"))
              .drop("epi_year", "epi_week"))
    return (weekly.join(pop.select("location", "population"), "location", "left")
            .withColumn("model", F.lit("Observed")))


def add_horizon_dates(raw: DataFrame, rounds: DataFrame, round_: int) -> DataFrame:
    """Parse ``"12 wk"`` and set ``target_end_date = origin + 7h - 1``."""
    origin = rounds.where(F.col("round") == round_).select("round", "origin_date")
    # the rounds dimension has one row per modelling round: broadcast it
    return (raw.withColumn("round", F.lit(round_))
            .join(F.broadcast(origin), "round", "inner")
            .withColumn("horizon", parse_horizon("horizon"))
            .withColumn("target_end_date", horizon_end_date("origin_date", "horizon"))
            .drop("origin_date"))


def drop_superseded(results: DataFrame, base: str, suffix: str = "_update") -> DataFrame:
    """If more than one model name starts with ``base``, drop the
    ``base + suffix`` submission. Distinct-model count is a scalar subquery."""
    n_variants = (results.where(F.col("model").startswith(base))
                  .select(F.countDistinct("model")).scalar())
    return results.where(~((F.col("model") == F.lit(base + suffix)) & (n_variants > 1)))


def models_per_target(results: DataFrame, keys=TARGET_KEYS) -> DataFrame:
    """A2: distinct models per target group (partial aggregation first)."""
    return results.groupBy(*keys).agg(F.countDistinct("model").alias("models"))


def min_model_filter(results: DataFrame, n_model_min: int = 3, keys=TARGET_KEYS) -> DataFrame:
    """Anti-join away target groups with fewer than ``n_model_min`` models."""
    thin = models_per_target(results, keys).where(F.col("models") < n_model_min).select(*keys)
    return results.join(thin, keys, "left_anti")


def attach_observed(results: DataFrame, obs: DataFrame) -> DataFrame:
    """Left join the observed weekly value as ``obs``."""
    o = obs.select("location", "target_variable", "target_end_date", F.col("value").alias("obs"))
    return results.join(o, ["location", "target_variable", "target_end_date"], "left")


def series_population(obs: DataFrame) -> DataFrame:
    """Population and name at each series' earliest week, one aggregate."""
    at = F.struct("target_end_date", "population")
    return (obs.groupBy("location", "location_name", "target_variable")
            .agg(F.min(at)["population"].alias("population"))
            .select("location", "target_variable", "location_name", "population"))


def one_per_key(dim: DataFrame, keys) -> DataFrame:
    """``dim`` as it is, but a second row of one key raises: a join on the keys can't multiply rows."""
    values = [c for c in dim.columns if c not in keys]
    g = dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in values])
    bad = F.concat(F.lit("more than one row for a key of " + ", ".join(keys) + ": "), F.concat_ws(", ", *keys))
    checked = F.when(F.col("_n") > 1, F.raise_error(bad).cast("boolean")).otherwise(F.lit(True))
    return g.where(checked).select(*keys, *values)


def attach_population(results: DataFrame, obs: DataFrame) -> DataFrame:
    """J4 + P3: population join and per-100k scaling (NULL on zero population)."""
    return (results.join(one_per_key(series_population(obs), ["location", "target_variable"]),
                         ["location", "target_variable"], "left")
            .withColumn("value_100k", F.try_divide(F.col("value"), F.col("population")) * 100000.0)
            .withColumn("obs_100k", F.try_divide(F.col("obs"), F.col("population")) * 100000.0))


def prepare_projections(raw: DataFrame, obs: DataFrame, rounds: DataFrame,
                        round_: int = 2, n_model_min: int = 3,
                        superseded: str | None = None) -> DataFrame:
    """Raw submissions -> scored-ready ``results`` table."""
    res = add_horizon_dates(raw, rounds, round_)
    if superseded:
        res = drop_superseded(res, superseded)
    res = min_model_filter(res, n_model_min)
    res = attach_observed(res, obs)
    return attach_population(res, obs)


def per_100k(df: DataFrame, cols=("value", "obs")) -> DataFrame:
    """P3 on its own: ``x / population * 100000`` for each column."""
    for c in cols:
        df = df.withColumn(f"{c}_100k", F.try_divide(F.col(c), F.col("population")) * 100000.0)
    return df
