"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajens.session import checkpoint_dir

#: ASCII white space, as the word rule ``[^\x20\x09-\x0D]+`` has it
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back. Later jobs and
    retried tasks then see one fixed copy, whatever executors are lost."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices (no copies) of at most ``rows`` rows: a task that makes Python objects of
    texts then holds those of few at a time, whatever the session's batch size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case, as in Spark)."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name = f"_{name}"
    return name


def partition_offsets(chunks: DataFrame, chunk: str, total: str) -> DataFrame:
    """(chunk, _before): exclusive running sum of ``total`` by chunk number. One row per partition
    of the job that wrote the chunks, so the single window task holds no data rows."""
    before = Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.select(chunk, F.coalesce(F.sum(total).over(before), F.lit(0)).alias("_before"))
