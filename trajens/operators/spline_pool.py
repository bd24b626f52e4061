"""Linear opinion pool of spline quantile functions (E4), in column expressions.

Each model's quantiles define a quantile function: between its outermost levels a monotone cubic
through the knots (level p, value x), beyond them a parametric tail. The pool is the equal-weight mixture
of the models: each quantile function is evaluated at the middles of ``grid`` equal parts of (0, 1), and the
answer is read off the sorted pooled values, the j-th of N of which holds probability (j - 1/2) / N. (Without
a bias at the ends, unlike type-7 quantiles of a coarse grid; both tend to the same pool as the grid grows.)

* **Interior.** Cubic Hermite pieces with slopes that keep each piece monotone: at an inner knot the
  weighted harmonic mean of the secants on either side (0 where one of them is), at the outer knots
  the outermost secant (Fritsch and Butland 1984). A level range on one value is flat, a linear
  function stays linear.
* **Tails.** A location-scale family through the two outermost knots: ``normal``, ``cauchy``, or
  ``clamped`` (all mass beyond on the outermost knot). Inverting the family's CDF needs its standard
  quantile only at the grid and the knots: constants of the grid, and for the knots' own levels one
  expression (:func:`normal_quantile`).

Plan: the knots (models x levels rows per target group) are dealt out by group once. Slopes and neighbours come
from windows over one model's knots, each knot gives its grid points (one generated row each, in
compiled expressions), and a group's ``models x grid`` values are sorted in one row: a bound set by the
models and the grid, not by the data. Nothing is exchanged after the first step.

Edge cases: levels with NULL values are skipped and a model without values isn't there; a single
knot is a constant; repeated rows of a model and level count once (their mean); NULL keys are groups of
their own; an empty table gives no rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajens.functions.quantiles import QUANTILE_LEVELS, label
from trajens.operators.quantiles import ENS_KEYS
from trajens.operators.ranked import shuffle_partitions

#: points of the probability grid: the middles of so many equal parts of (0, 1)
GRID = 1000
TAILS = ("normal", "cauchy", "clamped")


def standard_quantile(p: float, tails: str) -> float:
    """Quantile of the tail family's standard member."""
    return NormalDist().inv_cdf(p) if tails == "normal" else math.tan(math.pi * (p - 0.5))


def _table(levels, tails: str) -> Column:
    """Map from the usual levels to their standard quantiles."""
    return F.create_map(*[F.lit(v) for p in sorted(levels) for v in (float(p), standard_quantile(p, tails))])


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile: Hastings' start (Abramowitz and Stegun 26.2.23), then Newton steps on
    the log of the tail probability, which is taken from the continued fraction of Mills' ratio
    for far tails and from the series near the centre."""
    u = F.least(p, 1.0 - p)
    # fixed values: Hastings' coefficients
    t = F.sqrt(-2.0 * F.log(u))
    start = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1.0 + t * (1.432788 + t * (0.189269 + t * 0.001308)))

    def upper(z: Column) -> Column:
        """P(Z > z), z >= 0."""
        density = F.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
        series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(z.alias("s"), z.alias("t")),
                             lambda a, k: F.struct((a["s"] + a["t"] * z * z / (2 * k + 1)).alias("s"), (a["t"] * z * z / (2 * k + 1)).alias("t")),
                             lambda a: a["s"])
        mills = F.aggregate(F.sequence(F.lit(60), F.lit(1)), z, lambda r, k: z + k / r)
        return F.when(z < 3.0, 0.5 - density * series).otherwise(density / mills)

    def newton(z: Column, _: Column) -> Column:
        q = upper(z)
        return F.greatest(z + q * (F.log(q) - F.log(u)) * F.exp(z * z / 2.0) * math.sqrt(2.0 * math.pi), F.lit(0.0))

    z = F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.greatest(start, F.lit(0.0)), newton)
    return F.when(p == 0.5, 0.0).when(p < 0.5, -z).otherwise(z)


def _standard(p: Column, tails: str) -> Column:
    """Standard quantile at a knot's level: looked up for the usual levels, else computed."""
    other = normal_quantile(p) if tails == "normal" else F.tan(math.pi * (p - 0.5))
    return F.coalesce(F.try_element_at(_table(QUANTILE_LEVELS, tails), p), other)


def _point(p: Column, grid: int) -> Column:
    """Number of grid points at or below level ``p`` (a level that is a grid point to 1e-9 counts as one)."""
    return F.floor(p * grid + 0.5 + 1e-9).cast("int")


def spline_values(knots: DataFrame, keys, grid: int = GRID, tails: str = "normal") -> DataFrame:
    """keys + ``_v``: each model's quantile function at every grid point. ``knots``: one row per keys,
    ``_m``, ``_p`` (level), with its value ``_x``; dealt out by (some of) the keys."""
    if tails not in TAILS:
        raise ValueError(f"tails must be one of {TAILS}")
    w = Window.partitionBy(*keys, "_m").orderBy("_p")
    c = F.col
    near = (knots.withColumn("_z", F.lit(0.0) if tails == "clamped" else _standard(c("_p"), tails))
            .select("*", *[F.lead(f"_{n}").over(w).alias(f"_{n}1") for n in "pxz"], *[F.lag(f"_{n}").over(w).alias(f"_{n}0") for n in "pxz"]))
    h0, h1 = c("_p") - c("_p0"), c("_p1") - c("_p")
    d0, d1 = (c("_x") - c("_x0")) / h0, (c("_x1") - c("_x")) / h1
    w0, w1 = 2.0 * h1 + h0, h1 + 2.0 * h0
    inner = F.when((d0 > 0) & (d1 > 0), (w0 + w1) / (w0 / d0 + w1 / d1)).otherwise(0.0)
    sloped = near.withColumn("_s", F.when(c("_p0").isNull(), F.coalesce(d1, F.lit(0.0))).when(c("_p1").isNull(), d0).otherwise(inner))
    sloped = sloped.withColumn("_s1", F.lead("_s").over(w))
    # a knot's grid points: below the first knot, from a knot to the next, above the last
    own, single = _point(c("_p"), grid), c("_p0").isNull() & c("_p1").isNull()
    span = lambda kind, on, lo, hi: F.when(on, F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi")))
    spans = F.array_compact(F.array(
        span("below", c("_p0").isNull(), F.lit(1), F.when(single, F.lit(grid)).otherwise(own)),
        span("piece", c("_p1").isNotNull(), own + 1, _point(c("_p1"), grid)),
        span("above", c("_p1").isNull() & ~single, own + 1, F.lit(grid))))
    rows = sloped.select("*", F.explode(F.filter(spans, lambda r: r["hi"] >= r["lo"])).alias("_r"))
    rows = rows.select("*", F.explode(F.sequence("_r.lo", "_r.hi")).alias("_i"))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((c("_i") - 0.5) / grid - c("_p")) / h1))
    cubic = (c("_x") * (1.0 + 2.0 * t) * (1.0 - t) * (1.0 - t) + h1 * c("_s") * t * (1.0 - t) * (1.0 - t)
             + c("_x1") * t * t * (3.0 - 2.0 * t) + h1 * c("_s1") * t * t * (t - 1.0))
    if tails == "clamped":
        below = above = c("_x")
    else:
        z = F.get(F.array(*[F.lit(standard_quantile((k - 0.5) / grid, tails)) for k in range(1, grid + 1)]), c("_i") - 1)
        below = F.when(single, c("_x")).otherwise(c("_x") + (c("_x1") - c("_x")) / (c("_z1") - c("_z")) * (z - c("_z")))
        above = c("_x") + (c("_x") - c("_x0")) / (c("_z") - c("_z0")) * (z - c("_z"))
    value = F.when(c("_r.kind") == "piece", cubic).when(c("_r.kind") == "below", below).otherwise(above)
    return rows.select(*keys, value.alias("_v"))


def spline_pool(mq: DataFrame, keys=ENS_KEYS, levels=QUANTILE_LEVELS, model_col: str = "model",
                grid: int = GRID, tails: str = "normal") -> DataFrame:
    """``mq``: keys + model + quantile_level + value  ->  keys + quantile_level,
    quantile, value, model = "Linear pool"."""
    keys = list(keys)
    knots = (mq.where(F.col("value").isNotNull())
             .select(*keys, F.col(model_col).alias("_m"), F.col("quantile_level").cast("double").alias("_p"), F.col("value").alias("_x"))
             .repartition(shuffle_partitions(mq.sparkSession), *keys)  # few rows now, models x grid per group below
             .groupBy(*keys, "_m", "_p").agg(F.avg("_x").alias("_x")))
    pooled = spline_values(knots, keys, grid, tails).groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_v"))
    n = F.size("_v")

    def answer(p: float) -> Column:
        h = F.greatest(F.lit(0.0), F.least(F.lit(float(p)) * n - 0.5, (n - 1).cast("double")))
        lo, hi = F.floor(h).cast("int"), F.ceil(h).cast("int")
        return F.when(lo == hi, F.get("_v", lo)).otherwise((hi - h) * F.get("_v", lo) + (h - lo) * F.get("_v", hi))

    answers = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(label(p)).alias("q"), answer(p).alias("x")) for p in levels])
    return (pooled.select(*keys, F.explode(answers).alias("lv"))
            .select(*keys, F.col("lv.p").alias("quantile_level"), F.col("lv.q").alias("quantile"),
                    F.col("lv.x").alias("value"), F.lit("Linear pool").alias("model")))
