"""Quantile levels and their labels.

Labels follow the printed form of the level: ``0.05 -> "q0.05"``,
``0.1 -> "q0.1"``; the numeric level is carried next to the label so nothing
has to parse it back in the hot path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard 23 hub quantile levels (0.01, 0.025, 0.05 to 0.95
# by 0.05, 0.975, 0.99).
QUANTILE_LEVELS = [
    0.01, 0.025, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5,
    0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.975, 0.99,
]

# Levels drawn in the ensemble figures.
PLOT_LEVELS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
WEEKLY_PLOT_LEVELS = [0.01, 0.25, 0.5, 0.75, 0.99]


def label(p: float) -> str:
    return f"q{p:g}"


def label_col(level) -> Column:
    """Column form of :func:`label` (``concat('q', cast(p as string))``)."""
    level = F.col(level) if isinstance(level, str) else level
    return F.concat(F.lit("q"), level.cast("string"))


def level_from_label(lbl) -> Column:
    """``"q0.025" -> 0.025``."""
    lbl = F.col(lbl) if isinstance(lbl, str) else lbl
    return F.regexp_replace(lbl, "^q", "").cast("double")


def levels_frame(spark, levels=QUANTILE_LEVELS):
    """Tiny (level index, level, label) dimension; size = number of levels."""
    rows = [(i, float(p), label(p)) for i, p in enumerate(levels)]
    return spark.createDataFrame(rows, "level_idx int, quantile_level double, quantile string")


def interval_of(level) -> Column:
    """Central interval holding the level: ``round(2*|0.5-p|, 2)``."""
    level = F.col(level) if isinstance(level, str) else level
    return F.round(F.lit(2.0) * F.abs(F.lit(0.5) - level), 2)


def side_of(level) -> Column:
    level = F.col(level) if isinstance(level, str) else level
    return F.when(level <= 0.5, F.lit("lower")).otherwise(F.lit("upper"))
