"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

Every step is a minimum per node (combined map-side) joined back to the links, so a node with very
many links costs no more than its links. Links are written to the shared folder after each round,
which cuts the lineage; only two numbers per round come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajens.llm.common import store


def _large_star(e: DataFrame) -> DataFrame:
    sym = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (sym.where("v > u").join(low, "u")
            .select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(low, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))))


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """``links``: columns a, b (long). Returns (node, root) for every node that has a link to
    another node; root is the smallest node reachable."""
    e = store(links.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        e = store(_small_star(_large_star(e)).distinct(), name)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now
