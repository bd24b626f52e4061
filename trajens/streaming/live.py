"""Continuous evaluation as Structured Streaming jobs (ST1, ST2).

* :func:`weekly_rollup` — daily counts -> epi weeks (Sunday..Saturday) with
  an event-time watermark; a tumbling 7-day window offset by 3 days starts on
  Sundays (the epoch is a Thursday). The same function runs on a batch
  DataFrame, which is how the batch query and the stream are kept equal.
* :func:`score_refresh` — stream–static join of closed truth weeks to the
  projections, then a keyed streaming aggregate of (sum |error|, n) per
  trajectory; MAE = sum / n is exact under incremental updates and the state
  store (checkpointed) survives executor loss.
* :func:`start_score_table` — the same scores as a table that each micro-batch
  updates (``foreachBatch``), for readers outside the stream: :func:`read_scores`.
  A version of the table is named by its batch and made from the last version
  before it, so a batch that is replayed after a failure writes what it wrote before.
* :func:`start_weekly_table` — weekly ensembles as a table partitioned by forecast date. A score at a forecast
  date reads only the weeks before it, so a batch rebuilds the dates after its earliest new or
  corrected week and leaves the other partitions as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajens.operators.weighting import TRAJ, WEEK_KEYS, weekly_ensembles
from trajens.session import checkpoint_dir


def daily_from_events(events: DataFrame) -> DataFrame:
    """Events -> daily observations: location = event type, value = event value.
    ``ts`` is cast to a session-zone timestamp (watermarks need one; the
    session zone is UTC, so calendar days are unchanged)."""
    return events.select(F.col("event_type").alias("location"), F.col("ts").cast("timestamp").alias("ts"),
                         F.col("value"), F.lit("events").alias("target_variable"))


def weekly_rollup(daily: DataFrame, ts: str = "ts", watermark: str | None = "3 days") -> DataFrame:
    """Epi-week sums per (location, target); ``target_end_date`` = last day
    with data in the week (as in the batch rollup)."""
    d = daily.withWatermark(ts, watermark) if watermark and daily.isStreaming else daily
    win = F.window(F.col(ts), "7 days", "7 days", "3 days")
    return (d.groupBy("location", "target_variable", win.alias("w"))
            .agg(F.max(F.to_date(F.col(ts))).alias("target_end_date"),
                 F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"),
                 F.count(F.lit(1)).alias("n_obs"))
            .select("location", "target_variable", F.to_date(F.col("w.start")).alias("week_start"),
                    "target_end_date", "value", "n_obs"))


def score_refresh(truth_weeks: DataFrame, results: DataFrame) -> DataFrame:
    """Per-trajectory running (sum_ae, n_weeks_scored, mae) from a stream of
    weekly truth rows (location, target_variable, target_end_date, value)."""
    proj = results.select(*TRAJ, "target_end_date", "value_100k", "population")
    joined = truth_weeks.select("location", "target_variable", "target_end_date",
                                F.col("value").alias("obs")).join(
        proj, ["location", "target_variable", "target_end_date"], "inner")
    ae = F.abs(F.col("value_100k") - F.try_divide(F.col("obs"), F.col("population")) * 100000.0)
    return (joined.where(F.col("obs").isNotNull())
            .groupBy(*TRAJ)
            .agg(F.sum(ae).alias("sum_ae"), F.count(F.lit(1)).alias("n_weeks_scored"))
            .withColumn("mae", F.col("sum_ae") / F.col("n_weeks_scored")))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Batch ids of the complete versions under ``path``, ascending."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("batch=")]
    done = [p for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def _drop_version(spark: SparkSession, path: str, batch: int) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_SCORES = "location string, target_variable string, model string, sample int, scenario_id string, sum_ae double, n_weeks_scored long"


def update_scores(batch: DataFrame, batch_id: int, results: DataFrame, path: str, keep: int = 2) -> None:
    """Version ``batch_id`` of the score table: the last version before it plus this batch's closed
    weeks (location, target_variable, target_end_date, value). Run twice, it gives the same
    version: a version never reads itself or a later one. The ``keep`` latest versions stay, so that
    readers of the one before aren't disturbed and a replay finds its base. Rows are one per
    trajectory: the whole table is that small beside the projections."""
    spark = batch.sparkSession
    new = score_refresh(batch, results).select(*TRAJ, "sum_ae", "n_weeks_scored")
    before = [v for v in _versions(spark, path) if v < batch_id]
    if before:
        old = spark.read.schema(new.schema).parquet(f"{path}/batch={before[-1]}")
        new = (old.unionByName(new).groupBy(*TRAJ)
               .agg(F.sum("sum_ae").alias("sum_ae"), F.sum("n_weeks_scored").alias("n_weeks_scored")))
    new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    for v in [v for v in _versions(spark, path) if v <= batch_id][:-keep]:
        _drop_version(spark, path, v)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """The latest complete version, with ``mae``."""
    versions = _versions(spark, path)
    table = spark.read.parquet(f"{path}/batch={versions[-1]}") if versions else spark.createDataFrame([], _SCORES)
    return table.withColumn("mae", F.col("sum_ae") / F.col("n_weeks_scored"))


def start_score_table(truth_weeks: DataFrame, results: DataFrame, name: str, path: str | None = None,
                      trigger: dict | None = None):
    """ST2 as a stream: each micro-batch of closed truth weeks (each week once, as the append mode of
    :func:`weekly_rollup` gives them) updates the score table under ``path`` (by default beside the
    checkpoint). ``results`` is read anew by every batch: store it first."""
    spark = truth_weeks.sparkSession
    base = f"{checkpoint_dir(spark)}/streams/{name}"
    path = path or f"{base}/scores"
    w = (truth_weeks.writeStream.queryName(name).outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
         .foreachBatch(lambda batch, batch_id: update_scores(batch, batch_id, results, path)))
    return (w.trigger(**trigger) if trigger else w).start()


def observe(results: DataFrame, truth: DataFrame) -> DataFrame:
    """``results`` (with ``population``) with the observations of ``truth``, raw and per 100k."""
    seen = truth.select("location", "target_variable", "target_end_date", F.col("value").alias("obs"))
    bare = results.select(*[c for c in results.columns if c not in ("obs", "obs_100k")])
    return (bare.join(seen, ["location", "target_variable", "target_end_date"], "left")
            .withColumn("obs_100k", F.try_divide(F.col("obs"), F.col("population")) * 100000.0))


def update_weekly(batch: DataFrame, batch_id: int, results: DataFrame, path: str, keep: int = 2, **options) -> None:
    """Bring the weekly ensembles under ``path`` up to a batch of truth weeks (location, target_variable,
    target_end_date, value; a week sent again replaces its value, of two in one batch the greater stays).

    ``path/truth`` holds the weeks seen so far in versions named by batch, each made from the last one before
    it (one row per series and week). Weeks whose value differs from that version are the change;
    forecast dates after the earliest of them are computed anew and overwrite their partitions of ``path/table``,
    no others. The first batch writes every date. A replayed batch finds the same base, so the same change.
    ``options`` go to :func:`weekly_ensembles`."""
    spark = batch.sparkSession
    keys = ["location", "target_variable", "target_end_date"]
    new = batch.groupBy(*keys).agg(F.max(F.col("value").cast("double")).alias("value"))
    before, after = [v for v in _versions(spark, f"{path}/truth") if v < batch_id], None
    if before:
        old = spark.read.schema(new.schema).parquet(f"{path}/truth/batch={before[-1]}")
        both = old.withColumnRenamed("value", "was").join(new.withColumn("sent", F.lit(True)), keys, "full")
        merged = both.select(*keys, F.when(F.col("sent"), F.col("value")).otherwise(F.col("was")).alias("value"))
        changed = both.where(F.col("sent") & ~F.col("value").eqNullSafe(F.col("was")))
        after = changed.agg(F.min("target_end_date")).first()[0]
    else:
        merged = new
    # before the table: a batch that is cut off there is replayed from the version before its own
    merged.write.mode("overwrite").parquet(f"{path}/truth/batch={batch_id}")
    truth = spark.read.schema(new.schema).parquet(f"{path}/truth/batch={batch_id}")
    if not before or after is not None:
        fresh = weekly_ensembles(observe(results, truth), after=after, **options)
        (fresh.repartition("forecast_date", *WEEK_KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("forecast_date").parquet(f"{path}/table"))
    for v in [v for v in _versions(spark, f"{path}/truth") if v <= batch_id][:-keep]:
        _drop_version(spark, f"{path}/truth", v)


def read_weekly(spark: SparkSession, path: str) -> DataFrame:
    """The weekly ensembles that :func:`update_weekly` keeps under ``path``."""
    t = spark.read.parquet(f"{path}/table")
    return t.select(F.col("forecast_date").cast("date").alias("forecast_date"), *[c for c in t.columns if c != "forecast_date"])


def start_weekly_table(truth_weeks: DataFrame, results: DataFrame, name: str, path: str | None = None,
                       trigger: dict | None = None, **options):
    """E7 kept up by a stream of truth weeks, by default under the checkpoint's folder. ``results`` is read anew by
    every batch: store it first."""
    base = f"{checkpoint_dir(truth_weeks.sparkSession)}/streams/{name}"
    path = path or f"{base}/weekly"
    w = (truth_weeks.writeStream.queryName(name).outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
         .foreachBatch(lambda batch, batch_id: update_weekly(batch, batch_id, results, path, **options)))
    return (w.trigger(**trigger) if trigger else w).start()


def start(df: DataFrame, name: str, mode: str = "append", sink: str = "parquet", path: str | None = None,
          trigger: dict | None = None):
    """Start a streaming query with its checkpoint under the session's
    ``spark.checkpoint.dir`` (shared storage on a cluster). The default writes
    finished rows as Parquet, to ``path`` or a folder beside the checkpoint;
    ``sink="memory"`` gathers the result in the driver, for tests."""
    spark: SparkSession = df.sparkSession
    base = f"{checkpoint_dir(spark)}/streams/{name}"
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").queryName(name)
    if trigger:
        w = w.trigger(**trigger)
    if sink == "memory":
        return w.format("memory").start()
    return w.format(sink).start(path or f"{base}/data")
