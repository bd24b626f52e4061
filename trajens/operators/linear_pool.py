"""Linear opinion pool of quantile forecasts (E4), exact and without sampling.

Each model's quantiles define a piecewise-linear CDF through its knots
(value x, level p); levels tied at one value make a vertical step (left limit
= lowest level, value = highest). Mass below the lowest / above the highest
level sits on the outer knots. The pool is the equal-weight mean of the
models' CDFs, inverted at the requested levels.

Plan (per target group G with M models, at most 23 knots each):

1. knots: ``x = round(v, 9)``; per (G, model, x) ``pl = min(p)``, ``ph = max(p)``;
   each model's knots become one short array, in order of x.
2. every distinct x of the group meets every model of the group: at most
   23 M x M small rows, a bound set by the number of models, not by the data.
   A model's CDF at x (left limit and value) is read off its own array: its
   own step at x, linear interpolation between the two knots around x, 0
   before its first knot and 1 from its last on. No running sums, so nothing
   cancels and a flat stretch of the pool is flat to the last bit.
3. the pool is the mean over models of left limits and values (rounded to
   12 dp so that equal steps compare equal).
4. each level p is answered at the point where the pooled CDF first reaches p:
   the point itself when p lies in its step, else linear interpolation on
   the segment before it.

Deviation from the spline-based reference package: interpolation between
knots is linear and the tails are clamped (no parametric tails).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajens.functions.quantiles import QUANTILE_LEVELS, label
from trajens.operators.quantiles import ENS_KEYS


def linear_pool(mq: DataFrame, keys=ENS_KEYS, levels=QUANTILE_LEVELS,
                model_col: str = "model") -> DataFrame:
    """``mq``: keys + model + quantile_level + value  ->  keys + quantile_level,
    quantile, value, model = "Linear pool"."""
    keys = list(keys)
    knots = (mq.select(*keys, F.col(model_col).alias("_m"), F.col("quantile_level").alias("_p"),
                       F.round(F.col("value"), 9).alias("x"))
             .groupBy(*keys, "_m", "x")
             .agg(F.min("_p").alias("pl"), F.max("_p").alias("ph")))
    per_model = knots.groupBy(*keys, "_m").agg(F.array_sort(F.collect_list(F.struct("x", "pl", "ph"))).alias("_k"))
    per_group = per_model.groupBy(*keys).agg(F.collect_list("_k").alias("_ks"))
    points = per_group.select(*keys, "_ks", F.explode(F.array_distinct(F.flatten(
        F.transform("_ks", lambda k: F.transform(k, lambda e: e["x"]))))).alias("x"))

    def cdf(k: Column) -> Column:
        """(left limit, value) of one model's CDF at the point's x."""
        x = F.col("x")
        at = F.get(F.filter(k, lambda e: e["x"] == x), 0)
        lo = F.get(F.slice(F.filter(k, lambda e: e["x"] < x), -1, 1), 0)
        hi = F.get(F.filter(k, lambda e: e["x"] > x), 0)
        between = lo["ph"] + (hi["pl"] - lo["ph"]) * (x - lo["x"]) / (hi["x"] - lo["x"])
        left = F.when(lo["x"].isNull(), 0.0).when(at["x"].isNotNull(), at["pl"]).when(hi["x"].isNull(), 1.0).otherwise(between)
        right = F.when(hi["x"].isNull(), 1.0).when(at["x"].isNotNull(), at["ph"]).when(lo["x"].isNull(), 0.0).otherwise(between)
        return F.struct(left.alias("l"), right.alias("r"))

    at_x = points.select(*keys, "x", F.transform("_ks", cdf).alias("_f"))

    def mean(side: str) -> Column:
        return F.aggregate("_f", F.lit(0.0), lambda a, f: a + f[side], lambda a: a / F.size("_f"))

    pooled = at_x.select(*keys, "x", F.round(mean("l"), 12).alias("fl"), F.round(mean("r"), 12).alias("fr"))
    order = Window.partitionBy(*keys).orderBy("x")
    pooled = (pooled.withColumn("x_prev", F.lag("x").over(order))
              .withColumn("fr_prev", F.coalesce(F.lag("fr").over(order), F.lit(0.0))))
    lv = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(label(p)).alias("q")) for p in levels])
    hit = (pooled.select("*", F.explode(lv).alias("lv"))
           .where((F.col("lv.p") > F.col("fr_prev")) & (F.col("lv.p") <= F.col("fr"))))
    value = (F.when(F.col("x_prev").isNull() | (F.col("lv.p") > F.col("fl")), F.col("x"))
             .otherwise(F.col("x_prev") + (F.col("lv.p") - F.col("fr_prev"))
                        * (F.col("x") - F.col("x_prev")) / (F.col("fl") - F.col("fr_prev"))))
    return hit.select(*keys, F.col("lv.p").alias("quantile_level"), F.col("lv.q").alias("quantile"),
                      value.alias("value"), F.lit("Linear pool").alias("model"))
