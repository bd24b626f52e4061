"""File sources and sinks for hub-style submission trees.

* :func:`read_observed_csv`, :func:`read_population`, :func:`read_rounds` — daily truth (S1/S2), population
  (S3) and round metadata (S9), columns by the names in the header.
* :func:`read_submissions` — recursive ``*.csv`` listing (S4), model and
  submission date parsed from each file's path (S5), files outside the round's
  submission window never opened (S6), each file's columns found by its own header, malformed
  rows and unreadable files kept apart in a reject table instead of failing or vanishing (S7).
* :func:`read_round`, :func:`load_projections` — round Parquet, and the switch between the two
  sources (S8, S11).
* :func:`write_table`, :func:`write_submissions` — overwrite a table (S10), write a submission tree.

Paths are given by the user; nothing is downloaded.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, DoubleType, IntegerType, StringType, StructField,
                               StructType)

from trajens.session import materialize

OBSERVED_SCHEMA = StructType([
    StructField("location", StringType()), StructField("location_name", StringType()),
    StructField("date", DateType()), StructField("value", DoubleType()),
])

SUBMISSION_SCHEMA = StructType([
    StructField("location", StringType()), StructField("scenario_id", StringType()),
    StructField("target_variable", StringType()), StructField("horizon", StringType()),
    StructField("sample", IntegerType()), StructField("value", DoubleType()),
])

DATE_PATTERN = r"\d{4}-\d{2}-\d{2}"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//)?"


POPULATION_SCHEMA = StructType([StructField("location", StringType()), StructField("population", DoubleType())])

ROUNDS_SCHEMA = StructType([StructField("round", IntegerType()), StructField("origin_date", DateType()),
                            StructField("submission_window_end", DateType())])


def read_by_name(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv") -> DataFrame:
    """The columns of ``schema`` by name, whatever their order and whatever else the file holds. A
    missing column is an error, and so is a CSV folder whose files differ in their header; a field
    that isn't of its type is an error when it is read."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False).option("ignoreLeadingWhiteSpace", True)
    elif fmt == "json":
        reader = reader.option("primitivesAsString", True)
    df = reader.load(path)
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def read_observed_csv(spark: SparkSession, path: str, target_variable: str | None = None) -> DataFrame:
    df = read_by_name(spark, path, OBSERVED_SCHEMA)
    return df.withColumn("target_variable", F.lit(target_variable)) if target_variable else df


def read_population(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """S3: (location, population)."""
    return read_by_name(spark, path, POPULATION_SCHEMA, fmt)


def parse_submission_path(path_col, root: str = "") -> tuple:
    """(date, model) from ``<root>/<model>/<yyyy-mm-dd>-....csv``: the first date in the path after
    ``root``, and the folders between ``root`` and the dated name with slashes removed (a
    submission may be a file or a folder of files)."""
    p = F.col(path_col) if isinstance(path_col, str) else path_col
    # compare without the URI scheme: Spark reports local files as "file:/..."
    p = F.regexp_replace(p, SCHEME, "")
    root = re.sub(SCHEME, "", root)
    rest = F.substring(p, len(root) + 1, 1 << 20) if root else p
    date = F.to_date(F.nullif(F.regexp_extract(rest, DATE_PATTERN, 0), F.lit("")))
    folders = F.regexp_replace(F.regexp_extract(rest, r"/(.+)/", 0), "/" + DATE_PATTERN + ".*$", "")
    model = F.regexp_replace(folders, "/", "")
    return date, model


def list_files(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """Every matching file under ``root`` as (path, length), listed by Spark; contents are
    not read (only metadata columns are selected)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
            .load(root).select("path", "length"))


def relative_to(path: Column, root: str) -> Column:
    """``path`` without scheme and without ``root``."""
    return F.substring(F.regexp_replace(path, SCHEME, ""), len(re.sub(SCHEME, "", root)) + 1, 1 << 20)


def parse_paths(paths: DataFrame, root: str) -> DataFrame:
    date, model = parse_submission_path("path", root)
    return paths.select("path", date.alias("date"), model.alias("model"))


def in_window(parsed: DataFrame, rounds: DataFrame, round_: int) -> DataFrame:
    """Keep dates within [origin_date, submission_window_end]."""
    r = rounds.where(F.col("round") == round_)
    lo = r.select(F.min("origin_date")).scalar()
    hi = r.select(F.max("submission_window_end")).scalar()
    return parsed.where(F.col("date").between(lo, hi))


_QUOTED_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def csv_fields(line: Column) -> Column:
    """Fields of one CSV record (RFC 4180): commas inside quotes part nothing, a doubled quote inside
    quotes is one quote. NULL if the quotes don't match up."""
    parts = F.when(F.contains(line, F.lit('"')), F.split(line, _QUOTED_COMMA, -1)).otherwise(F.split(line, ",", -1))
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))

    def plain(x: Column) -> Column:
        x = F.trim(x)
        inside = F.substring(x, F.lit(2), F.length(x) - 2)
        return F.when(x.rlike(r'^"(?:[^"]|"")*"$'), F.replace(inside, F.lit('""'), F.lit('"'))).otherwise(x)

    return F.when(quotes % 2 == 0, F.transform(parts, plain))


def submission_files(spark: SparkSession, root: str, rounds: DataFrame, round_: int) -> DataFrame:
    """(path, length, date, model) of the files in the round's window; contents are not read."""
    date, model = parse_submission_path("path", root)
    return in_window(list_files(spark, root).withColumns({"date": date, "model": model}), rounds, round_)


def read_submissions(spark: SparkSession, root: str, rounds: DataFrame, round_: int,
                     schema: StructType = SUBMISSION_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Rows and rejects of every ``*.csv`` under ``root`` in the round's window.

    Files are listed first; only those in the window are opened. Each file's header (its line that
    holds every name of ``schema``, in any order, quoted or not, beside any other columns) says where its
    columns are: one small stored table, joined by file. Lines are read as text and parsed with the full
    schema whatever columns the consumer asks for, and a row is a row only if it has as many fields as
    its header and every field of ``schema`` parses. ``rejects`` (model, _file, line, reason) has the
    other lines, and one row with a NULL line for a file that can't be read, has no such header or
    two different ones: none of its lines are rows. Empty files are neither. One record per line
    (quoted line breaks are not part of the format). Lines are read twice (headers, then rows)."""
    names = [f.name for f in schema.fields]
    inside = materialize(submission_files(spark, root, rounds, round_), "submission-files")
    # as many paths as Spark's own file index on the driver holds
    paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r.path) for r in inside.where("length > 0").select("path").collect()]
    if paths:
        # a file that can't be opened shows up below as one without a header
        lines = (spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).text(paths)
                 # text metadata has the path URL-encoded; a plus sign stands for itself there
                 .withColumn("_file", F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")))
                 .withColumn("value", F.regexp_replace("value", "^\ufeff", "")))
    else:
        lines = spark.createDataFrame([], "value string, _file string")
    lines = lines.where(F.trim("value") != "").withColumn("_at", F.regexp_replace("_file", SCHEME, ""))
    likely = F.lit(True)
    for n in names:
        likely = likely & F.col("value").contains(n)
    fields = csv_fields(F.col("value"))
    headers = materialize(
        lines.where(likely).withColumn("_names", fields)
        .where(F.forall(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains("_names", n)))
        .groupBy("_at").agg(F.collect_set("_names").alias("_sets")).where(F.size("_sets") == 1)
        .select("_at", F.get("_sets", 0).alias("_names"))
        .where(F.size(F.filter("_names", lambda x: x.isin(names))) == len(names)), "submission-headers")
    known = inside.withColumn("_at", F.regexp_replace("path", SCHEME, ""))
    placed = lines.join(headers.join(known.select("_at", "model"), "_at"), "_at").withColumn("_parts", fields)
    is_header = F.col("_parts") == F.col("_names")
    typed, wrong = [], F.when(F.col("_parts").isNull(), "quotes").when(F.size("_parts") != F.size("_names"), "number of fields")
    for f in schema.fields:
        raw = F.nullif(F.get("_parts", F.array_position("_names", f.name).cast("int") - 1), F.lit(""))
        value = raw if isinstance(f.dataType, StringType) else raw.try_cast(f.dataType)
        wrong = wrong.when(raw.isNotNull() & value.isNull(), f.name)
        typed.append(value.alias(f.name))
    parsed = placed.where(~F.coalesce(is_header, F.lit(False))).withColumn("_wrong", wrong)
    rows = parsed.where(F.col("_wrong").isNull()).select(*typed, "model", F.lit(round_).alias("round"))
    whole = (known.where("length > 0").join(headers.select("_at"), "_at", "left_anti")
             .select("model", F.col("path").alias("_file"), F.lit(None).cast("string").alias("line"), F.lit("unreadable or no header").alias("reason")))
    rejects = (parsed.where(F.col("_wrong").isNotNull())
               .select("model", "_file", F.col("value").alias("line"), F.col("_wrong").alias("reason")).unionByName(whole))
    return rows, rejects


def read_round(spark: SparkSession, path: str) -> DataFrame:
    """One round's projections as Parquet, with the file's own schema."""
    return spark.read.parquet(path)


def read_rounds(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Round metadata (round, origin_date, submission_window_end) from CSV, JSON or Parquet."""
    return read_by_name(spark, path, ROUNDS_SCHEMA, fmt)


def load_projections(spark: SparkSession, source: str, path: str, rounds: DataFrame, round_: int) -> DataFrame:
    """Raw projections from a tree of submissions (``source="files"``) or from the round's
    Parquet (``source="parquet"``), in the same columns."""
    names = [f.name for f in SUBMISSION_SCHEMA.fields] + ["model", "round"]
    if source == "files":
        return read_submissions(spark, path, rounds, round_)[0].select(*names)
    if source == "parquet":
        return read_round(spark, path).withColumn("round", F.lit(round_)).select(*names)
    raise ValueError(f"unknown source {source!r}: files or parquet")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> None:
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_submissions(raw: DataFrame, root: str, dates: Column, schema: StructType = SUBMISSION_SCHEMA, pieces: int = 8) -> None:
    """Write ``raw`` as a submission tree ``<root>/<model>/<date>-<scenario>/part-*.csv``:
    one folder per model and submission, ``dates`` giving the submission date of a row. A
    submission's rows are dealt to ``pieces`` tasks by their hash, so a large one isn't one task's; at most
    as many files come of it. Spark writes the files; folder names are then put into the tree's form by
    renames, one per folder."""
    spark = raw.sparkSession
    cols = [F.col(f.name) for f in schema.fields]
    staged = f"{root}/_staged"
    (raw.select(*cols, F.col("model").alias("m"), F.concat_ws("-", F.date_format(dates, "yyyy-MM-dd"), "scenario_id").alias("s"))
     .repartition("m", "s", F.pmod(F.xxhash64(*[f.name for f in schema.fields]), F.lit(pieces))).write.mode("overwrite").option("header", True).partitionBy("m", "s").csv(staged))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    for m in fs.listStatus(jvm.org.apache.hadoop.fs.Path(staged)):
        if not m.isDirectory():
            continue
        model = m.getPath().getName().partition("=")[2]
        for s in fs.listStatus(m.getPath()):
            fs.mkdirs(jvm.org.apache.hadoop.fs.Path(base, model))
            fs.rename(s.getPath(), jvm.org.apache.hadoop.fs.Path(base, f"{model}/{s.getPath().getName().partition('=')[2]}"))
    fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)
