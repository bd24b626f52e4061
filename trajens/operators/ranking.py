"""Global ordering without a single-partition window.

``row_number() OVER (ORDER BY ...)`` with no partition moves every row to one
task. Here the rows are range-partitioned and sorted by the order key (a
distributed sort) and written once, with their partition number and their
place in it, to the shared folder; a per-partition count table (one row per
partition) then supplies the offsets. Both sides of that join read the one
written copy, so no row can fall between two evaluations of the sort. The
order key must be total (add a unique tie-breaker) for the numbering to be
the same on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajens.session import materialize

_LOW = (1 << 33) - 1


def global_row_number(df: DataFrame, order, name: str = "row_number") -> DataFrame:
    cols = df.columns
    # monotonically_increasing_id: partition number in the upper bits, place in the lower 33
    ranked = materialize(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    ranked = (ranked.withColumn("_part", F.shiftright("_mid", 33))
              .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(_LOW))))
    counts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the window below holds #partitions rows only
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    return (ranked.join(F.broadcast(offsets.select("_part", "_off")), "_part")
            .select(*cols, (F.col("_off") + F.col("_pos") + 1).alias(name)))
