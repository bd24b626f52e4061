"""File sources and sinks: CSV truth, recursive submission tree with path
parsing, window pruning and a reject table, table writer."""
import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from trajens.sources import files as FS
from conftest import rows


def _scratch():
    return tempfile.mkdtemp(prefix="trajens-test-src-", dir=os.environ.get("TMPDIR", "/tmp"))


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def test_read_observed_csv_with_tag(spark):
    root = _scratch()
    _write(f"{root}/cases.csv", "location,location_name,date,value\nBE,Belgium,2022-07-24,3\nBE,Belgium,2022-07-25,\n")
    df = FS.read_observed_csv(spark, f"{root}/cases.csv", "inc case")
    assert rows(df, "location", "date", "value", "target_variable") == [
        ("BE", dt.date(2022, 7, 24), 3.0, "inc case"), ("BE", dt.date(2022, 7, 25), None, "inc case")]


def test_read_submissions_tree(spark):
    root = _scratch()
    head = "location,scenario_id,target_variable,horizon,sample,value\n"
    _write(f"{root}/teamA-model1/2022-07-24-teamA-model1.csv", head + "BE,A,inc case,1 wk,1,5.5\nBE,A,inc case,2 wk,1,6.5\n")
    _write(f"{root}/teamB-m2/2022-07-26-teamB-m2.csv", head + "NL,B,inc death,1 wk,2,1.0\nNL,B,inc death,oops,not-a-number,x\n")
    _write(f"{root}/teamC/2022-09-01-teamC.csv", head + "ES,A,inc case,1 wk,1,9.0\n")     # outside the window
    _write(f"{root}/teamA-model1/notes.txt", "not a csv\n")
    rounds = spark.createDataFrame([(2, dt.date(2022, 7, 24), dt.date(2022, 7, 31))],
                                   "round int, origin_date date, submission_window_end date")
    good, bad = FS.read_submissions(spark, root, rounds, 2)
    got = rows(good, "model", "location", "horizon", "sample", "value", "round")
    assert got == [("teamA-model1", "BE", "1 wk", 1, 5.5, 2), ("teamA-model1", "BE", "2 wk", 1, 6.5, 2),
                   ("teamB-m2", "NL", "1 wk", 2, 1.0, 2)]
    rej = bad.collect()
    assert len(rej) == 1 and rej[0].model == "teamB-m2" and "oops" in rej[0].line


def test_parse_paths_and_window(spark):
    paths = spark.createDataFrame([("/hub/m1/2022-07-25-m1.csv",), ("/hub/m2/2022-08-30-m2.csv",)], "path string")
    parsed = FS.parse_paths(paths, "/hub")
    assert rows(parsed, "model", "date") == [("m1", dt.date(2022, 7, 25)), ("m2", dt.date(2022, 8, 30))]
    rounds = spark.createDataFrame([(2, dt.date(2022, 7, 24), dt.date(2022, 7, 31))],
                                   "round int, origin_date date, submission_window_end date")
    assert rows(FS.in_window(parsed, rounds, 2), "model") == [("m1",)]


def test_write_table_roundtrip(spark):
    root = _scratch()
    df = spark.range(0, 50).select(F.col("id").cast("int").alias("i"), (F.col("id") % 3).alias("k"))
    FS.write_table(df, f"{root}/t", partition_by=["k"])
    back = spark.read.parquet(f"{root}/t")
    assert back.count() == 50 and sorted(r.k for r in back.select("k").distinct().collect()) == [0, 1, 2]
    FS.write_table(df.where("i < 5"), f"{root}/t")          # overwrite
    assert spark.read.parquet(f"{root}/t").count() == 5


def _tree(spark):
    root = _scratch()
    head = "location,scenario_id,target_variable,horizon,sample,value\n"
    _write(f"{root}/m1/2022-07-24-m1.csv", head + "BE,A,inc case,1 wk,1,5.5\nNL,A,inc case,1 wk,2,\n"
           "BE,A,inc case,bad,x1,1.0\nshort,row\nBE,A,inc case,1 wk,3,nan-ish\n")
    _write(f"{root}/m2/2022-09-01-m2.csv", "this file lies outside the window\n")
    rounds = spark.createDataFrame([(2, dt.date(2022, 7, 24), dt.date(2022, 7, 31))],
                                   "round int, origin_date date, submission_window_end date")
    return root, rounds


def test_malformed_rows_stay_out_whatever_is_selected(spark):
    root, rounds = _tree(spark)
    good, bad = FS.read_submissions(spark, root, rounds, 2)
    assert good.count() == 2 and bad.count() == 3
    assert rows(good.groupBy("model", "location").count()) == [("m1", "BE", 1), ("m1", "NL", 1)]
    assert rows(good.select("horizon")) == [("1 wk",), ("1 wk",)]
    assert sorted(r.line.split(",")[0] for r in bad.select("line").collect()) == ["BE", "BE", "short"]
    assert rows(good, "value") == [(5.5,), (None,)]


def test_files_outside_the_window_are_not_read(spark):
    root, rounds = _tree(spark)
    os.chmod(f"{root}/m2/2022-09-01-m2.csv", 0)
    good, _ = FS.read_submissions(spark, root, rounds, 2)
    assert good.count() == 2
    scan = good._jdf.queryExecution().executedPlan().toString()
    read = good.select(F.col("model")).distinct().collect()
    assert [r.model for r in read] == ["m1"] and "file_path" in scan


def test_written_tree_reads_back_and_sources_agree(spark):
    root = _scratch()
    raw = spark.createDataFrame([("m1", "BE", "A", "inc case", "1 wk", 1, 2.5), ("m1", "BE", "B", "inc case", "2 wk", 1, 3.5),
                                 ("m 2", "NL", "A", "inc death", "1 wk", 7, None)],
                                "model string, location string, scenario_id string, target_variable string, "
                                "horizon string, sample int, value double")
    day = F.when(F.col("scenario_id") == "A", F.lit("2022-07-25")).otherwise(F.lit("2022-08-25")).cast("date")
    FS.write_submissions(raw, f"{root}/hub", day)
    FS.write_table(raw, f"{root}/round.parquet")
    _write(f"{root}/rounds.csv", "round,origin_date,submission_window_end\n2,2022-07-24,2022-07-31\n")
    rounds = FS.read_rounds(spark, f"{root}/rounds.csv")
    a = FS.load_projections(spark, "files", f"{root}/hub", rounds, 2)
    b = FS.load_projections(spark, "parquet", f"{root}/round.parquet", rounds, 2)
    cols = a.columns
    assert rows(a, *cols) == rows(b.where("scenario_id = 'A'"), *cols) and a.columns == b.columns
    listed = FS.list_files(spark, f"{root}/hub")
    assert {r.model for r in FS.parse_paths(listed, f"{root}/hub").collect()} == {"m1", "m 2"}


ROUNDS = "round int, origin_date date, submission_window_end date"


def test_columns_are_found_by_each_files_header(spark):
    root = _scratch()
    _write(f"{root}/m1/2022-07-24-a.csv", "scenario_id,location,target_variable,horizon,sample,value\nA,BE,inc case,1 wk,1,5.5\n")
    _write(f"{root}/m2/2022-07-25-b.csv", "\ufeff\"value\",\"sample\", note ,horizon,target_variable,scenario_id,location\n"
           "7.5,3,\"a, \"\"quoted\"\" note\",2 wk,inc case,A,\"B,E\"\n8.5,4,,2 wk,inc case,A,NL\n")
    _write(f"{root}/m3/2022-07-26-c.csv", "location,scenario_id,target_variable,horizon,sample,value\n"
           "BE,A,inc case,1 wk,1,\"1.5\"\nBE,A,\"inc case,1 wk,1,2.5\nBE,A,inc case,1 wk,1,2.5,extra\nBE,A,inc case,1 wk,one,2.5\n")
    _write(f"{root}/m4/2022-07-27-d.csv", "location,scenario_id,target_variable,horizon,sample\nBE,A,inc case,1 wk,1\n")     # a column lacks
    _write(f"{root}/m5/2022-07-27-e.csv", "BE,A,inc case,1 wk,1,9.0\n")                                                      # no header
    _write(f"{root}/m6/2022-07-27-f.csv", "location,scenario_id,target_variable,horizon,sample,value\nBE,A,inc case,1 wk,1,1.0\n"
           "value,location,scenario_id,target_variable,horizon,sample\n2.0,BE,A,inc case,1 wk,1\n")                          # two headers
    _write(f"{root}/m7/2022-07-27-g.csv", "")                                                                                # empty: neither
    _write(f"{root}/m 8/2022-07-27-h [x].csv", "location,scenario_id,target_variable,horizon,sample,value\nBE,A,inc case,1 wk,1,4.0\n")
    rounds = spark.createDataFrame([(2, dt.date(2022, 7, 24), dt.date(2022, 7, 31))], ROUNDS)
    good, bad = FS.read_submissions(spark, root, rounds, 2)
    assert rows(good, "model", "location", "scenario_id", "horizon", "sample", "value") == [
        ("m 8", "BE", "A", "1 wk", 1, 4.0), ("m1", "BE", "A", "1 wk", 1, 5.5), ("m2", "B,E", "A", "2 wk", 3, 7.5),
        ("m2", "NL", "A", "2 wk", 4, 8.5), ("m3", "BE", "A", "1 wk", 1, 1.5)]
    assert good.count() == 5 and rows(good.select("sample")) == [(1,), (1,), (1,), (3,), (4,)]
    got = rows(bad, "model", "reason")
    assert got == [("m3", "number of fields"), ("m3", "quotes"), ("m3", "sample"), ("m4", "unreadable or no header"),
                   ("m5", "unreadable or no header"), ("m6", "unreadable or no header")]
    assert bad.where("line is null").count() == 3 and bad.where("line like '%extra'").count() == 1


def test_a_file_that_cannot_be_opened_is_rejected_whole(spark):
    root = _scratch()
    head = "location,scenario_id,target_variable,horizon,sample,value\n"
    _write(f"{root}/m1/2022-07-24-a.csv", head + "BE,A,inc case,1 wk,1,5.5\n")
    _write(f"{root}/m2/2022-07-25-b/part.csv", head + "NL,A,inc case,1 wk,1,6.5\n")
    _write(f"{root}/m3/2022-07-25-c.csv", head + "NL,A,inc case,1 wk,1,7.5\n")
    os.chmod(f"{root}/m3/2022-07-25-c.csv", 0)
    closed = not os.access(f"{root}/m3/2022-07-25-c.csv", os.R_OK)
    rounds = spark.createDataFrame([(2, dt.date(2022, 7, 24), dt.date(2022, 7, 31))], ROUNDS)
    good, bad = FS.read_submissions(spark, root, rounds, 2)
    assert {r.model for r in good.collect()} == {"m1", "m2"} | (set() if closed else {"m3"})
    assert {(r.model, r.line) for r in bad.collect()} == ({("m3", None)} if closed else set())


def test_no_file_in_the_window(spark):
    root = _scratch()
    _write(f"{root}/m1/2023-07-24-a.csv", "x\n")
    rounds = spark.createDataFrame([(2, dt.date(2022, 7, 24), dt.date(2022, 7, 31))], ROUNDS)
    good, bad = FS.read_submissions(spark, root, rounds, 2)
    assert good.count() == 0 == bad.count()


def test_truth_population_and_rounds_by_name(spark):
    import pytest
    root = _scratch()
    _write(f"{root}/t.csv", "value,date,location,extra,location_name\n3,2022-07-24,BE,x,\"Bel, gium\"\n")
    _write(f"{root}/p.csv", "name,population,location\nBelgium,11500000,BE\n")
    _write(f"{root}/r.csv", "submission_window_end,round,origin_date\n2022-07-31,2,2022-07-24\n")
    _write(f"{root}/r.json", '{"round": 2, "submission_window_end": "2022-07-31", "origin_date": "2022-07-24"}\n')
    assert rows(FS.read_observed_csv(spark, f"{root}/t.csv")) == [("BE", "Bel, gium", dt.date(2022, 7, 24), 3.0)]
    assert rows(FS.read_population(spark, f"{root}/p.csv")) == [("BE", 11500000.0)]
    want = [(2, dt.date(2022, 7, 24), dt.date(2022, 7, 31))]
    assert rows(FS.read_rounds(spark, f"{root}/r.csv")) == want == rows(FS.read_rounds(spark, f"{root}/r.json", "json"))
    with pytest.raises(Exception, match="population"):
        FS.read_population(spark, f"{root}/t.csv").collect()


def test_a_submission_is_written_by_several_tasks(spark):
    root = _scratch()
    raw = spark.range(4000).select(F.lit("m1").alias("model"), F.lit("BE").alias("location"), F.lit("A").alias("scenario_id"),
                                   F.lit("inc case").alias("target_variable"), F.lit("1 wk").alias("horizon"),
                                   F.col("id").cast("int").alias("sample"), F.lit(1.0).alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be merged here
    try:
        FS.write_submissions(raw, f"{root}/hub", F.lit("2022-07-25").cast("date"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = [f for _, _, fs in os.walk(f"{root}/hub/m1") for f in fs if f.endswith(".csv")]
    assert 1 < len(files) <= 8
    rounds = spark.createDataFrame([(2, dt.date(2022, 7, 24), dt.date(2022, 7, 31))], ROUNDS)
    good, bad = FS.read_submissions(spark, f"{root}/hub", rounds, 2)
    assert good.select("sample").distinct().count() == 4000 == good.count() and bad.count() == 0
