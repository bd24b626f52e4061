import os
import tempfile
import uuid

from pyspark.sql import functions as F

from trajens.operators.weighting import weekly_ensembles
from trajens.streaming.live import (_versions, daily_from_events, observe, read_scores, read_weekly, score_refresh, start,
                                    start_score_table, start_weekly_table, update_scores, update_weekly, weekly_rollup)
from conftest import rows

SF = "/root/testdata/sf0.001"


def test_stream_rollup_equals_batch(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    batch = weekly_rollup(daily_from_events(events), watermark=None)
    stream_in = (spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet")
                 .parquet(SF))
    # a fresh query name = a fresh checkpoint (a reused name resumes its stream)
    name = f"t_rollup_{uuid.uuid4().hex[:8]}"
    q = start(weekly_rollup(daily_from_events(stream_in), watermark="3650 days"),
              name, mode="complete", sink="memory", trigger={"availableNow": True})
    q.awaitTermination(300)
    got = spark.table(name)
    cols = ("location", "week_start", "target_end_date", "value", "n_obs")
    assert rows(got, *cols) == rows(batch, *cols)
    q.stop()


def test_score_refresh_is_incremental_mae(spark):
    import datetime as dt
    d = [dt.date(2022, 1, 1) + dt.timedelta(days=7 * i) for i in range(3)]
    res = spark.createDataFrame(
        [("BE", "inc case", "m", 1, "A", d[i], v, 100.0) for i, v in enumerate((1.0, 2.0, 4.0))],
        "location string, target_variable string, model string, sample int, scenario_id string, "
        "target_end_date date, value_100k double, population double")
    root = tempfile.mkdtemp(prefix="trajens-test-truth-", dir=os.environ.get("TMPDIR", "/tmp"))
    schema = "location string, target_variable string, target_end_date date, value double"
    truth = [("BE", "inc case", d[0], 0.002), ("BE", "inc case", d[1], 0.001)]
    spark.createDataFrame(truth[:1], schema).write.parquet(f"{root}/w0")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(root)
    name = f"t_scores_{uuid.uuid4().hex[:8]}"
    q = start(score_refresh(stream, res), name, mode="complete", sink="memory", trigger={"availableNow": True})
    q.awaitTermination(300)
    first = spark.table(name).first()
    assert first.n_weeks_scored == 1 and abs(first.mae - 1.0) < 1e-12
    spark.createDataFrame(truth[1:], schema).write.parquet(f"{root}/w1")
    # same name: resumes from the checkpoint and picks up only the new week
    q2 = start(score_refresh(stream, res), name, mode="complete", sink="memory", trigger={"availableNow": True})
    q2.awaitTermination(300)
    r = spark.table(name).first()
    # week 1: obs 0.001 -> 1 per 100k, error |2 - 1| = 1; MAE over two weeks = 1
    assert r.n_weeks_scored == 2 and abs(r.mae - 1.0) < 1e-12


def test_append_mode_drops_late_rows_and_resumes_to_parquet(spark):
    root = tempfile.mkdtemp(prefix="trajens-test-late-", dir=os.environ.get("TMPDIR", "/tmp"))
    schema = "event_type string, ts timestamp, value double"

    def put(n, *rows_):
        spark.createDataFrame([(t, __import__("datetime").datetime.fromisoformat(ts), float(v)) for t, ts, v in rows_], schema).coalesce(
            1).write.parquet(f"{root}/in/{n}")

    def run():
        stream = (spark.readStream.schema(schema).option("recursiveFileLookup", True)
                  .option("maxFilesPerTrigger", 1).parquet(f"{root}/in"))
        q = start(weekly_rollup(daily_from_events(stream), watermark="3 days"), name, path=f"{root}/out",
                  trigger={"availableNow": True})
        q.awaitTermination(300)

    name = f"t_late_{uuid.uuid4().hex[:8]}"
    put("a", ("x", "2022-01-03", 1), ("x", "2022-01-05", 2))          # week of 2 January
    put("b", ("x", "2022-01-20", 5))                                   # watermark 17 January: that week closes
    run()
    got = spark.read.parquet(f"{root}/out")
    assert rows(got, "location", "value", "n_obs") == [("x", 3.0, 2)]
    put("c", ("x", "2022-01-04", 100), ("x", "2022-01-21", 1))         # 4 January is late: dropped
    put("d", ("x", "2022-02-20", 1))                                   # closes the week of 16 January
    run()                                                              # same name: resumes from its checkpoint
    got = spark.read.parquet(f"{root}/out")
    assert rows(got, "location", "value", "n_obs") == [("x", 3.0, 2), ("x", 6.0, 2)]


WEEKS = "location string, target_variable string, target_end_date date, value double"


def _scored_world(spark):
    import datetime as dt
    d = [dt.date(2022, 1, 1) + dt.timedelta(days=7 * i) for i in range(6)]
    res = spark.createDataFrame(
        [("BE", "inc case", m, s, "A", d[i], float(i + s * (m == "a")), 1000.0 + s) for m in "ab" for s in range(4) for i in range(6)],
        "location string, target_variable string, model string, sample int, scenario_id string, "
        "target_end_date date, value_100k double, population double")
    weeks = [("BE", "inc case", d[i], 0.01 * i + 0.003) for i in range(5)] + [("BE", "inc case", d[5], None)]
    return res, weeks


def _same(spark, path, res, weeks):
    cols = ("model", "sample", "n_weeks_scored")
    got, want = read_scores(spark, path), score_refresh(spark.createDataFrame(weeks, WEEKS), res)
    assert rows(got, *cols) == rows(want, *cols)
    for a, b in zip(rows(got, "model", "sample", "mae"), rows(want, "model", "sample", "mae"), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9


def test_a_replayed_batch_changes_nothing(spark):
    res, weeks = _scored_world(spark)
    path = tempfile.mkdtemp(prefix="trajens-test-scores-", dir=os.environ.get("TMPDIR", "/tmp")) + "/t"
    assert read_scores(spark, path).count() == 0
    for b, (lo, hi) in enumerate([(0, 1), (1, 3), (3, 3), (3, 6)]):  # one batch is empty, one has a NULL week
        batch = spark.createDataFrame(weeks[lo:hi], WEEKS)
        update_scores(batch, b, res, path)
        _same(spark, path, res, weeks[:hi])
        update_scores(batch, b, res, path)
        _same(spark, path, res, weeks[:hi])
    assert _versions(spark, path) == [2, 3]
    # a version whose write was cut off is no version
    os.makedirs(f"{path}/batch=4")
    _same(spark, path, res, weeks)


def test_score_table_stream_restarts_and_replays(spark):
    res, weeks = _scored_world(spark)
    root = tempfile.mkdtemp(prefix="trajens-test-weeks-", dir=os.environ.get("TMPDIR", "/tmp"))
    name, n = f"t_table_{uuid.uuid4().hex[:8]}", 0

    def put(*some):
        nonlocal n
        n += 1
        spark.createDataFrame(list(some), WEEKS).coalesce(1).write.parquet(f"{root}/in/{n}")

    def run():
        stream = (spark.readStream.schema(WEEKS).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"))
        q = start_score_table(stream, res, name, path=f"{root}/scores", trigger={"availableNow": True})
        q.awaitTermination(300)
        assert q.exception() is None

    put(*weeks[:2])
    put(weeks[2])
    run()
    _same(spark, f"{root}/scores", res, weeks[:3])
    put(*weeks[3:])
    run()                                     # resumes: only the new weeks
    _same(spark, f"{root}/scores", res, weeks)
    # the last batch's commit is lost: it is replayed under its own number
    from trajens.session import checkpoint_dir
    commits = f"{checkpoint_dir(spark).split(':', 1)[-1]}/streams/{name}/checkpoint/commits"
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        if os.path.exists(f"{commits}/{f}"):
            os.remove(f"{commits}/{f}")
    before = _versions(spark, f"{root}/scores")
    run()
    assert _versions(spark, f"{root}/scores") == before
    _same(spark, f"{root}/scores", res, weeks)


LEVELS = (0.25, 0.5, 0.9)


def _weekly_equals_batch(spark, path, res, weeks):
    want = weekly_ensembles(observe(res, spark.createDataFrame(weeks, WEEKS)), LEVELS)
    cols = sorted(want.columns)
    got = read_weekly(spark, path)
    assert sorted(got.columns) == cols
    a, b = ([tuple(round(r[c], 9) if c == "value" and r[c] is not None else r[c] for c in cols) for r in d.collect()] for d in (got, want))
    assert sorted(map(str, a)) == sorted(map(str, b)) and a


def _files(path):
    return {d: sorted(f for f in os.listdir(f"{path}/table/{d}") if f.endswith(".parquet"))
            for d in os.listdir(f"{path}/table") if d.startswith("forecast_date=")}


def test_weekly_table_rebuilds_only_later_forecast_dates(spark):
    res, weeks = _scored_world(spark)
    path = tempfile.mkdtemp(prefix="trajens-test-weekly-", dir=os.environ.get("TMPDIR", "/tmp")) + "/t"
    day = [w[2] for w in weeks]
    moved = lambda a, b: {d.partition("=")[2] for d in b if a.get(d) != b[d]}
    update_weekly(spark.createDataFrame(weeks[:2], WEEKS), 0, res, path, levels=LEVELS)
    _weekly_equals_batch(spark, path, res, weeks[:2])
    first = _files(path)
    update_weekly(spark.createDataFrame(weeks[2:4], WEEKS), 1, res, path, levels=LEVELS)
    _weekly_equals_batch(spark, path, res, weeks[:4])
    second = _files(path)
    assert len(second) == 6 and moved(first, second) == {str(d) for d in day[3:]}
    # replayed: the same dates, the same rows
    update_weekly(spark.createDataFrame(weeks[2:4], WEEKS), 1, res, path, levels=LEVELS)
    _weekly_equals_batch(spark, path, res, weeks[:4])
    third = _files(path)
    assert moved(second, third) == {str(d) for d in day[3:]}
    # weeks that say nothing new, then none at all
    update_weekly(spark.createDataFrame(weeks[1:3], WEEKS), 2, res, path, levels=LEVELS)
    update_weekly(spark.createDataFrame([], WEEKS), 3, res, path, levels=LEVELS)
    assert _files(path) == third and _versions(spark, f"{path}/truth") == [2, 3]
    # a corrected week beside a new one: dates after the corrected one
    fixed = [weeks[0], (*weeks[1][:3], 0.5), *weeks[2:5]]
    update_weekly(spark.createDataFrame([fixed[1], fixed[4]], WEEKS), 4, res, path, levels=LEVELS)
    _weekly_equals_batch(spark, path, res, fixed)
    assert moved(third, _files(path)) == {str(d) for d in day[2:]}


def test_weekly_table_stream_restarts(spark):
    res, weeks = _scored_world(spark)
    root = tempfile.mkdtemp(prefix="trajens-test-weeks-", dir=os.environ.get("TMPDIR", "/tmp"))
    name = f"t_weekly_{uuid.uuid4().hex[:8]}"
    for n, some in enumerate((weeks[:3], weeks[3:])):
        spark.createDataFrame(list(some), WEEKS).coalesce(1).write.parquet(f"{root}/in/{n}")
        stream = spark.readStream.schema(WEEKS).option("recursiveFileLookup", True).parquet(f"{root}/in")
        q = start_weekly_table(stream, res, name, path=f"{root}/w", trigger={"availableNow": True}, levels=LEVELS)
        q.awaitTermination(300)
        assert q.exception() is None
        _weekly_equals_batch(spark, f"{root}/w", res, weeks[:3] if n == 0 else weeks)
    assert _versions(spark, f"{root}/w/truth") == [0, 1]
