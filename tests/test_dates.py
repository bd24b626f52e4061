import datetime as dt

from pyspark.sql import functions as F

from trajens.functions.dates import epi_week, epi_week_end, epi_year, horizon_end_date, parse_horizon


def _mmwr(d: dt.date):
    """Independent epi week: week 1 holds the year's first Wednesday... computed
    from the first Sunday-started week with >= 4 days in the year."""
    def week1_start(y):
        jan1 = dt.date(y, 1, 1)
        dow = (jan1.weekday() + 1) % 7          # 0 = Sunday
        start = jan1 - dt.timedelta(days=dow)
        return start if dow <= 3 else start + dt.timedelta(days=7)
    y = d.year
    for cand in (y + 1, y, y - 1):
        s = week1_start(cand)
        if d >= s:
            return cand, (d - s).days // 7 + 1


def test_epi_weeks_match_independent_rule(spark):
    days = [dt.date(1995, 1, 1) + dt.timedelta(days=i) for i in range(0, 13000, 3)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select("d", epi_year("d").alias("y"), epi_week("d").alias("w")).collect()
    bad = [(r.d, r.y, r.w, _mmwr(r.d)) for r in got if (r.y, r.w) != _mmwr(r.d)]
    assert not bad, bad[:5]


def test_week_end_and_horizon(spark):
    df = spark.createDataFrame([(dt.date(2022, 7, 24), "12 wk"), (dt.date(2022, 7, 24), "1 wk")],
                               "origin date, h string")
    out = df.select(parse_horizon("h").alias("h"),
                    horizon_end_date("origin", parse_horizon("h")).alias("end"),
                    epi_week_end(F.col("origin")).alias("sat")).collect()
    assert out[0].h == 12 and out[0].end == dt.date(2022, 10, 15)
    assert out[1].h == 1 and out[1].end == dt.date(2022, 7, 30)
    assert out[0].sat == dt.date(2022, 7, 30)
