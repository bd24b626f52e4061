"""Domain tables derived from the star-schema test tables.

The engine works on long trajectory tables; the test data is a TPC-H-like
star schema. This adapter re-expresses it, entirely as Spark transforms:

* season: the last epi-year in the data is the observed season, its first
  Sunday the round's origin; it ends where the data end, so later weeks have
  no observation. All earlier epi-years are simulated seasons.
* projections: lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ region shipped before
  the origin, aggregated to one value per (location, model, scenario, sample,
  horizon week): location = region (or nation) name, model = market segment,
  scenario A/B = line status F/O, sample = epi-year, horizon = epi week 1..53;
  ``inc case`` = sum(quantity), ``inc death`` = line count.
* truth_daily: the same join, shipped from the origin on, per location and
  day, each measure divided by 10 (the share of one of 5 segments x 2 statuses).
* population: customers per location * 1000.

Every line item is either in the projections or in the truth, at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajens.functions.dates import epi_wednesday, epi_week, epi_year

TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")

ROUND = 2
WINDOW_DAYS = 29   # length of the submission window after the origin
SHARE = 10         # 5 market segments x 2 line statuses


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row (origin, last_date): first Sunday of the last epi-year and last
    ship date; reads one lineitem column."""
    last = read(spark, sf_dir, "lineitem").select(F.max(F.to_date("l_shipdate")).alias("last_date"))
    new_year = F.make_date(F.year(epi_wednesday("last_date")), F.lit(1), F.lit(1))
    # epi week 1 holds the year's first Wednesday (dayofweek 4) and starts three days before it
    return last.select(F.date_add(new_year, F.pmod(F.lit(4) - F.dayofweek(new_year), F.lit(7)) - 3).alias("origin"),
                       "last_date")


def origin(spark: SparkSession, sf_dir: str) -> Column:
    """The season's origin as a scalar subquery."""
    return season(spark, sf_dir).select("origin").scalar()


def last_date(spark: SparkSession, sf_dir: str) -> Column:
    return season(spark, sf_dir).select("last_date").scalar()


def _line_facts(spark, sf_dir, level, observed: bool) -> DataFrame:
    """Lines of the observed season or of all earlier ones, with their location
    and market segment. Only the needed lineitem columns are read."""
    day = F.to_date("l_shipdate")
    start = origin(spark, sf_dir)
    li = (read(spark, sf_dir, "lineitem")
          .select("l_orderkey", "l_quantity", "l_linestatus", "l_shipdate")
          .where(day >= start if observed else day < start))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # nation (25 rows) and region (5 rows) are fixed-size dimensions: broadcast.
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    loc = F.col("r_name") if level == "region" else F.col("n_name")
    return (li.join(orders, li.l_orderkey == orders.o_orderkey)
            .join(cust, F.col("o_custkey") == cust.c_custkey)
            .join(F.broadcast(geo), F.col("c_nationkey") == geo.n_nationkey)
            .select(loc.alias("location"), F.col("c_mktsegment").alias("model"),
                    "l_quantity", "l_linestatus", F.to_date("l_shipdate").alias("ship_date")))


def _two_measures(df: DataFrame, keys, scale=None) -> DataFrame:
    """Unpivot the case / death measures into (target_variable, value)."""
    case = F.col("sum_qty") if scale is None else F.col("sum_qty") / scale
    death = F.col("n_lines").cast("double") if scale is None else F.col("n_lines") / scale
    return df.select(*keys, F.explode(F.array(
        F.struct(F.lit("inc case").alias("target_variable"), case.alias("value")),
        F.struct(F.lit("inc death").alias("target_variable"), death.alias("value")),
    )).alias("m")).select(*keys, "m.target_variable", "m.value")


def projections_raw(spark: SparkSession, sf_dir: str, level: str = "region") -> DataFrame:
    """Raw submissions: model, location, scenario_id, target_variable,
    horizon ("12 wk"), sample, value."""
    facts = _line_facts(spark, sf_dir, level, observed=False)
    cells = (facts
             .withColumn("sample", epi_year("ship_date")).withColumn("week", epi_week("ship_date"))
             .withColumn("scenario_id", F.when(F.col("l_linestatus") == "F", "A").otherwise("B"))
             .groupBy("location", "model", "scenario_id", "sample", "week")
             .agg(F.sum("l_quantity").alias("sum_qty"), F.count(F.lit(1)).alias("n_lines")))
    cells = cells.withColumn("horizon", F.concat(F.col("week").cast("string"), F.lit(" wk")))
    keys = ["model", "location", "scenario_id", "sample", "horizon"]
    return _two_measures(cells, keys).select(
        "model", "location", "scenario_id", "target_variable", "horizon", "sample", "value")


def truth_daily(spark: SparkSession, sf_dir: str, level: str = "region") -> DataFrame:
    """Daily observations: location, location_name, date, value, target_variable."""
    facts = _line_facts(spark, sf_dir, level, observed=True)
    daily = (facts.groupBy("location", F.col("ship_date").alias("date"))
             .agg(F.sum("l_quantity").alias("sum_qty"), F.count(F.lit(1)).alias("n_lines")))
    out = _two_measures(daily, ["location", "date"], scale=SHARE)
    return out.select("location", F.col("location").alias("location_name"), "date",
                      "value", "target_variable")


def truth_daily_target(spark, sf_dir, target_variable: str, level: str = "region") -> DataFrame:
    """One observed CSV's worth: daily truth of one target, without the tag."""
    return (truth_daily(spark, sf_dir, level)
            .where(F.col("target_variable") == target_variable)
            .drop("target_variable"))


def population(spark: SparkSession, sf_dir: str, level: str = "region") -> DataFrame:
    cust = read(spark, sf_dir, "customer").select("c_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    per_nation = cust.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    loc = F.col("r_name") if level == "region" else F.col("n_name")
    return (per_nation.join(F.broadcast(geo), per_nation.c_nationkey == geo.n_nationkey)
            .groupBy(loc.alias("location"))
            .agg((F.sum("n") * 1000.0).alias("population")))


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round metadata (one row per round): the observed season's."""
    return season(spark, sf_dir).select(
        F.lit(ROUND).alias("round"), F.col("origin").alias("origin_date"),
        F.date_add("origin", WINDOW_DAYS).alias("submission_window_end"))


def target_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered target labels (level, label, ord) derived from the region table:
    ``"EUROPE inc case" -> "europe cases"``; cases first, then deaths, each in
    region-key order. Levels missing from a dimension map to NULL."""
    region = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    n = region.select(F.count(F.lit(1))).scalar()
    cases = region.select(
        F.concat("r_name", F.lit(" inc case")).alias("level"),
        F.concat(F.lower("r_name"), F.lit(" cases")).alias("label"),
        (F.col("r_regionkey") + 1).alias("ord"))
    deaths = region.select(
        F.concat("r_name", F.lit(" inc death")).alias("level"),
        F.concat(F.lower("r_name"), F.lit(" deaths")).alias("label"),
        (F.col("r_regionkey") + 1 + n).alias("ord"))
    return cases.unionByName(deaths).select("level", "label", F.col("ord").cast("int"))


def contributor_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model metadata table (model, team_name, model_abbr, methods) derived from
    the customer table: one 'team' per market segment."""
    cust = read(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey")
    return (cust.groupBy(F.col("c_mktsegment").alias("model"))
            .agg(F.count(F.lit(1)).alias("n_customers"),
                 F.countDistinct("c_nationkey").alias("n_nations"))
            .select("model",
                    F.concat(F.lower("model"), F.lit(" team")).alias("team_name"),
                    F.substring("model", 1, 4).alias("model_abbr"),
                    F.concat(F.lit("segment model on "), F.col("n_customers").cast("string"),
                             F.lit(" customers in "), F.col("n_nations").cast("string"),
                             F.lit(" nations")).alias("methods")))
