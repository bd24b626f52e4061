"""Skew-safe order statistics: a hot group spread over many range partitions
must give the same answers as the single-task aggregates."""
import math

import numpy as np
from pyspark.sql import functions as F

from trajens.functions.quantiles import QUANTILE_LEVELS
from trajens.operators.quantiles import group_quantiles
from trajens.operators.ranked import Late, chunk_of, ordered_positions, part_of, ranked_quantiles, split_points
from trajens.operators.weighting import group_ensembles, weighted_quantile


def _skewed(spark, n_hot=4000, seed=2):
    rng = np.random.default_rng(seed)
    data = [(0, i, float(v)) for i, v in enumerate(rng.gamma(2, 10, n_hot).round(2))]  # hot group, ties
    for g in range(1, 6):
        k = int(rng.integers(1, 30))
        data += [(g, i, float(v)) for i, v in enumerate(rng.normal(0, 5, k))]
    data += [(6, 0, 3.5)]                                                                 # single row
    return spark.createDataFrame(data, "g int, i int, v double").repartition(13)


def test_hot_group_spans_several_chunks(spark):
    df = _skewed(spark)
    pos = ordered_positions(df, ["g"], "v")
    hot = sorted((r._x, r._k, r._rank, r._nx) for r in pos.where("g = 0").collect())
    assert len({chunk for (chunk,) in pos.where("g = 0").select(chunk_of(F.col("_x"))).collect()}) > 100
    assert hot[-1][2] == 4000 and hot[-1][3] is None and sum(h[1] for h in hot) == 4000
    run = 0
    for i, (x, k, rank, nx) in enumerate(hot):
        run += k
        assert rank == run and (i == len(hot) - 1 or nx == hot[i + 1][0] > x)


def test_chunks_keep_the_order_of_all_doubles(spark):
    rng = np.random.default_rng(1)
    xs = np.concatenate([rng.normal(0, 10.0**e, 50) for e in range(-300, 300, 25)] + [2.0**np.arange(-1074, 1024, 97.0),
                        [0.0, 1.0, -1.0, np.nextafter(1, 0), np.nextafter(1, 2), 5e-324, -5e-324, 1.7e308, -1.7e308]])
    xs = np.sort(xs)
    rows = spark.createDataFrame([(float(x),) for x in xs] + [(float("inf"),), (float("-inf"),), (float("nan"),)], "x double")
    got = {r.x: r.c for r in rows.where("not isnan(x)").select("x", chunk_of(F.col("x")).alias("c")).collect()}
    order = sorted(got)
    assert all(got[a] <= got[b] for a, b in zip(order, order[1:]))


def test_every_consumer_sees_all_rows(spark):
    """count(), one column, a filter and a full read agree whatever the plan's settings."""
    df = _skewed(spark).withColumn("w", (F.col("i") % 7 + 1).cast("double"))
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.exchange.reuse")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for parts in ("1", "8", "33"):
            for aqe in ("true", "false"):
                for reuse in ("true", "false"):
                    for k, v in zip(keys, (parts, aqe, reuse)):
                        spark.conf.set(k, v)
                    out = weighted_quantile(df, ["g"], "v", "w")
                    full = out.collect()
                    assert len(full) == 7 * len(QUANTILE_LEVELS) == out.count() == len(out.select("g").collect())
                    half = out.where("quantile = 'q0.5'")
                    assert half.count() == 7 == len(half.collect()) == half.agg(F.count("value")).first()[0]
                    assert ordered_positions(df, ["g"], "v").agg(F.sum("_k")).first()[0] == df.count()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_ranked_equals_percentile(spark):
    df = _skewed(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        a = {(r.g, r.quantile_level): r.value
             for r in group_quantiles(df, ["g"], "v", with_count=True, method="ranked").collect()}
        b = {(r.g, r.quantile_level): r.value
             for r in group_quantiles(df, ["g"], "v", with_count=True, method="exact").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a.keys() == b.keys() and len(a) == 7 * len(QUANTILE_LEVELS)
    for k in a:
        assert math.isclose(a[k], b[k], rel_tol=1e-12, abs_tol=1e-12), (k, a[k], b[k])


def test_weighted_quantile_chunked_equals_single_partition(spark):
    df = _skewed(spark, n_hot=3000).withColumn("w", (F.col("i") % 7 + 1).cast("double"))
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        many = {(r.g, r.quantile_level): r.value
                for r in weighted_quantile(df, ["g"], "v", "w").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = {(r.g, r.quantile_level): r.value
               for r in weighted_quantile(df, ["g"], "v", "w").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert many.keys() == one.keys()
    for k in many:
        assert math.isclose(many[k], one[k], rel_tol=1e-9, abs_tol=1e-9), k


def test_null_group_key_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 2.0)], "g int, v double")
    got = {(r.g, r.quantile_level): r.value
           for r in group_quantiles(df, ["g"], "v", levels=[0.5]).collect()}
    assert got == {(None, 0.5): 2.0, (1, 0.5): 2.0}


def test_close_values_are_split_until_no_part_is_over_the_bound(spark):
    """A million distinct values within 0.1 %, all in one or two fixed chunks."""
    n, most = 1_000_000, 20_000
    df = spark.range(n).select(F.lit("hot").alias("g"), (F.lit(1e6) + F.pmod(F.col("id") * 7919, F.lit(n)) / 1000.0).alias("v"))
    df = df.unionByName(spark.createDataFrame([("small", 1.0), ("small", 3.0), (None, 5.0)], "g string, v double"))
    assert df.select(chunk_of(F.col("v")).alias("c")).where("c > 5000000").count() == 0
    assert df.where("g = 'hot'").select(chunk_of(F.col("v"))).distinct().count() <= 2
    values = df.where("g = 'hot'").select(F.struct("g").alias("_g"), F.col("v").alias("_x"))
    cuts = split_points(values, most)
    parts = (values.select("_g", "_x", chunk_of(F.col("_x")).alias("_c")).join(cuts, ["_g", "_c"])
             .groupBy("_c", part_of("_cuts", F.col("_x")).alias("s")).count())
    sizes = [r["count"] for r in parts.collect()]
    assert sum(sizes) == n and max(sizes) <= most and len(sizes) < 8 * n / most
    q = {(r.g, r.quantile_level): r.value for r in ranked_quantiles(df, ["g"], "v", [0.01, 0.5, 0.99], most=most).collect()}
    for p in (0.01, 0.5, 0.99):
        assert math.isclose(q["hot", p], 1e6 + p * (n - 1) / 1000.0, rel_tol=1e-12)
    assert q["small", 0.5] == 2.0 and q[None, 0.99] == 5.0


def test_bisection_and_ties(spark):
    rows = [(i, [1.0, 2.0, 2.5, 7.0][:k]) for i in range(9) for k in range(5)] + [(3, None)]
    df = spark.createDataFrame(rows, "x int, cuts array<double>").withColumn("v", F.col("x").cast("double"))
    for r in df.select("*", part_of("cuts", F.col("v")).alias("p")).collect():
        assert r.p == sum(c < r.v for c in r.cuts or [])
    # one value holds nearly all rows: it is one row of its chunk, and no split is needed
    tied = spark.range(5000).select(F.lit(1).alias("g"), F.when(F.col("id") < 4990, 3.0).otherwise(F.col("id") * 1.0).alias("v"))
    assert {r.quantile_level: r.value for r in ranked_quantiles(tied, ["g"], "v", [0.1, 0.9], most=100).collect()} == {0.1: 3.0, 0.9: 3.0}


def test_large_and_small_groups_agree(spark):
    """Chunked, split and whole groups, weighted and not, with late keys and without."""
    rng = np.random.default_rng(4)
    n = 2500
    rows = [(int(g), float(v), float(w)) for g, v, w in zip(rng.integers(0, 4, n) ** 2, (1000 + rng.gamma(2, 0.2, n)).round(4), rng.uniform(0.1, 3, n))]
    df = spark.createDataFrame([*rows, (None, 1.0, 2.0), (None, 2.0, 1.0)], "g int, v double, w double")
    key = lambda r: (r.g is None, r.g, r.kind, r.quantile_level)
    runs = {m: sorted(group_ensembles(df, ["g"], "v", "w", most=m).collect(), key=key) for m in (10, 600, 100_000)}
    for m in (10, 600):
        for a, b in zip(runs[m], runs[100_000], strict=True):
            assert key(a) == key(b) and math.isclose(a.value, b.value, rel_tol=1e-10)
    days = df.withColumn("by", F.array(*[F.struct(F.lit(d).alias("d"), (F.col("w") * d).alias("w")) for d in (1, 2, 5)]))
    late = Late(("d",), "by", lambda by, _: F.transform(by, lambda e: F.struct(F.struct(e["d"].alias("d")).alias("h"), e["w"].alias("w"))))
    for m in (10, 100_000):
        out = group_ensembles(days, ["g"], "v", None, most=m, late=late).collect()
        assert len(out) == 3 * len(runs[m])
        for d in (1, 2, 5):  # weights of another scale: the same quantiles
            for a, b in zip(sorted((r for r in out if r.d == d), key=key), runs[m], strict=True):
                assert math.isclose(a.value, b.value, rel_tol=1e-9)


def test_weekly_rows_are_copied_behind_the_last_exchange(spark):
    from trajens.operators import weighting as W
    from trajens.plans import domain as D
    out = W.weekly_ensembles(D.stored_results(spark, "/root/testdata/sf0.001"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    lines = plan[:plan.index("Subqueries")].splitlines() if "Subqueries" in plan else plan.splitlines()
    exchanges = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x]
    dates = max(i for i, x in enumerate(lines) if "Generate explode" in x)
    # top down: levels, one partial sum per group and date, windows, dates; below them the one exchange of rows
    assert [i for i in exchanges if i > dates] == exchanges[-1:] and "_h#" not in lines[exchanges[-1]]
    assert all("partial_sum" in lines[i + 1] for i in exchanges[:-1])


def test_far_positions_take_no_beta(spark):
    from trajens.operators import weighting as W
    n = 400
    df = spark.range(n).select(F.lit(1).alias("g"), F.sqrt("id").alias("v"), (F.col("id") % 3 + 1.0).alias("w"))
    pos = ordered_positions(df, ["g"], "v", "w")
    jvm = {r.quantile_level: r.value for r in weighted_quantile(df, ["g"], "v", "w", jvm_beta=True).collect()}
    hits = pos.select(F.explode(W._weighted_hits(QUANTILE_LEVELS)).alias("lv"))
    c, a, b = (F.col(f"lv.{x}") for x in "cab")
    p, far = a / (a + b), None
    far = (a + b) * (p * F.log(c / p) + (1 - p) * F.log((1 - c) / (1 - p))) < -W._TAIL
    calls = hits.where(c.isNotNull() & ~far).count()
    assert 0 < calls < 0.5 * n * len(QUANTILE_LEVELS)
    # and the sums are those of all positions
    from trajens.functions.beta import regularized_beta
    x = np.sqrt(np.arange(n))
    w = np.arange(n) % 3 + 1.0
    cw, nw = np.cumsum(w) / w.sum(), w.sum() ** 2 / (w ** 2).sum()
    for r in weighted_quantile(df, ["g"], "v", "w").collect():
        ib = regularized_beta(np.append(cw[:-1], 1.0), np.full(n, (nw + 1) * r.quantile_level), np.full(n, (nw + 1) * (1 - r.quantile_level)))
        want = float((x * np.diff(ib, prepend=0.0)).sum())
        assert math.isclose(r.value, want, rel_tol=1e-9) and math.isclose(jvm[r.quantile_level], want, rel_tol=1e-9)
