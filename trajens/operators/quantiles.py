"""Exact (type 7) group quantiles and the simple ensembles built from them.

``group_quantiles`` defaults to ``method="ranked"``
(:mod:`trajens.operators.ranked`): groups are cut into value-range chunks by a
range shuffle and each level is answered by the row at its rank, so no group
is ever gathered in one task, however hot. ``method="exact"`` evaluates all
levels in one ``percentile`` aggregate (map-side partial value->count maps,
merged per group in one task: fine when groups are known to be small) and
``method="approx"`` uses ``percentile_approx`` (bounded sketch per group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajens.functions.quantiles import QUANTILE_LEVELS, label

ENS_KEYS = ["round", "location", "target_variable", "target_end_date", "scenario_id"]


def _levels_array(levels):
    return F.array(*[F.lit(float(p)) for p in levels])


def _labels_array(levels):
    return F.array(*[F.lit(label(p)) for p in levels])


def group_quantiles(df: DataFrame, keys, value: str = "value_100k", levels=QUANTILE_LEVELS,
                    with_count: bool = False, method: str = "ranked") -> DataFrame:
    """Rows ``keys + [n?] + quantile_level, quantile, value`` (one per level)."""
    keys = list(keys)
    if method == "ranked":
        from trajens.operators.ranked import ranked_quantiles
        return ranked_quantiles(df, keys, value, levels, with_count=with_count)
    if method == "approx":
        agg = F.percentile_approx(F.col(value), _levels_array(levels), 100000)
    else:
        agg = F.percentile(F.col(value), _levels_array(levels))
    aggs = [agg.alias("qv")]
    if with_count:
        aggs.insert(0, F.count(F.lit(1)).alias("n"))
    extra = ["n"] if with_count else []
    g = df.groupBy(*keys).agg(*aggs)
    return (g.select(*keys, *extra, F.posexplode("qv").alias("i", "value"))
            .select(*keys, *extra,
                    _levels_array(levels)[F.col("i")].alias("quantile_level"),
                    _labels_array(levels)[F.col("i")].alias("quantile"),
                    "value"))


def ensemble_trajectories(results: DataFrame, levels=QUANTILE_LEVELS, keys=ENS_KEYS,
                          method: str = "ranked") -> DataFrame:
    """A3: quantiles over every trajectory of every model per target group."""
    return (group_quantiles(results, keys, "value_100k", levels, with_count=True, method=method)
            .withColumn("model", F.lit("Trajectories")))


def model_quantiles(results: DataFrame, levels=QUANTILE_LEVELS, keys=ENS_KEYS,
                    method: str = "ranked") -> DataFrame:
    """A4: each model's own quantiles per target group."""
    return group_quantiles(results, list(keys) + ["model"], "value_100k", levels, method=method)


def ensemble_quantiles(mq: DataFrame, keys=ENS_KEYS) -> DataFrame:
    """A5: median across models of each quantile level (Vincent average,
    median variant), with the number of models. ``mq`` = :func:`model_quantiles`."""
    return (mq.groupBy(*keys, "quantile_level", "quantile")
            .agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("value"))
            .withColumn("model", F.lit("Quantiles")))


def simple_ensembles(results: DataFrame, levels=QUANTILE_LEVELS, method: str = "ranked") -> DataFrame:
    """Quantile ensemble ∪ trajectory ensemble."""
    q = ensemble_quantiles(model_quantiles(results, levels, method=method))
    t = ensemble_trajectories(results, levels, method=method)
    return q.unionByName(t)


def union_all(*frames: DataFrame) -> DataFrame:
    """O2: union by column name, missing columns NULL-filled."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
