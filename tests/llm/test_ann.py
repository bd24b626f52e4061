import numpy as np
from pyspark.sql import functions as F

from trajens.llm import ann


def brute(ids, x, asked, k):
    out = {}
    for q in asked:
        s = (x * x[ids.tolist().index(q)]).sum(axis=1)
        order = sorted((-v, i) for v, i in zip(s, ids.tolist()) if i != q)[:k]
        out[q] = [(i, -v) for v, i in order]
    return out


def rows_of(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def clustered(rng, n, dim, size=30):
    centres = rng.normal(size=(n // size, dim))
    x = np.repeat(centres, size, axis=0) + 0.05 * rng.normal(size=(n // size * size, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, ids int")


def recall(got, want):
    hit = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hit / sum(len(w) for w in want.values())


def test_hilbert_curve_visits_every_cell_next_to_the_last():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = ann.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_recall_scores_and_order(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([clustered(rng, 1500, 16), rng.normal(size=(500, 16)).astype(np.float32)])
    ids = rng.permutation(len(x)) * 3
    want = brute(ids, x.astype(float), [i for i in ids.tolist() if i % 20 == 0], 20)
    got_rows = ann.nearest(frame(spark, ids, x), F.col("vec_id") % 20 == 0, block=32).collect()
    got = rows_of(got_rows)
    assert set(got) == set(want) and recall(got, want) >= 0.95
    at = {int(i): v.astype(float) for i, v in zip(ids, x)}
    for q, found in got.items():
        assert all(abs(s - float((at[q] * at[i]).sum())) < 1e-12 for i, s in found)
        assert found == sorted(found, key=lambda t: (-t[1], t[0])) and q not in dict(found)
    scanned = {r.query_id for r in got_rows if r.scanned}
    assert scanned and scanned != set(got)
    for q in scanned:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_one_vector_holds_a_third(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([np.tile(rng.normal(size=8), (200, 1)), rng.normal(size=(400, 8))]).astype(np.float32)
    ids = rng.permutation(len(x))
    want = brute(ids, x.astype(float), [i for i in ids.tolist() if i % 20 == 0], 20)
    got = rows_of(ann.nearest(frame(spark, ids, x), F.col("vec_id") % 20 == 0, block=16).collect())
    assert recall(got, want) >= 0.95
    hot = set(ids[:200].tolist())
    for q in want:
        if q in hot:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_rows_that_take_no_part_and_few_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [0.0, 2.0]), (40, None), (60, []), (80, [0.0, 0.0]), (100, [1.0, None]),
            (120, [nan, 1.0]), (140, [inf, 1.0]), (None, [1.0, 1.0]), (160, [1.0, 2.0, 3.0]), (20, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(ann.nearest(df, F.col("vec_id") % 20 == 0, k=3).collect())
    assert got == {0: [(20, 0.5), (21, 0.0)], 20: [(21, 1.0), (0, 0.5)]}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 40"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_op4_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    t = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in t]), np.array([v for _, v in t], float)
    want = brute(ids, x, [i for i in ids.tolist() if i % 20 == 0], 20)
    assert recall(rows_of(ann.op4_nearest(spark, sf).collect()), want) >= 0.9


def test_copies_are_one_observation(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 32))
    # near most queries only copies of one vector; the rest of the neighbours lie in all directions
    x = np.vstack([np.repeat(centres, 17, axis=0), rng.normal(size=(1500, 32))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = rng.permutation(len(x))
    want = brute(ids, x.astype(float), [i for i in ids.tolist() if i % 20 == 0], 20)
    got = rows_of(ann.nearest(frame(spark, ids, x), F.col("vec_id") % 20 == 0, block=64).collect())
    assert recall(got, want) >= 0.99
    h = ann.vector_hash(np.array([[0.0, 1.0], [-0.0, 1.0], [1.0, 0.0], [1.0, 1.0]]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3


def test_best_rows_and_their_floor():
    rng = np.random.default_rng(3)
    x, ids = rng.integers(-2, 3, size=(40, 3)).astype(float), rng.permutation(60)[:40]
    qid = np.concatenate([ids[:5], [100, 101]])
    q = np.vstack([x[:5], rng.integers(-2, 3, size=(2, 3))])
    floor = np.array([-np.inf, 3, 3, -np.inf, 50, 3, -np.inf])
    i, j, s = ann.best_of(q, qid, x, ids, 4, floor)
    assert np.array_equal(s, (q[i] * x[j]).sum(axis=1))
    for n in range(len(q)):
        every = {int(a): float((q[n] * v).sum()) for a, v in zip(ids, x) if a != qid[n]}
        least = floor[n] if np.isfinite(floor[n]) else sorted(every.values())[-4]  # ties stay
        assert {int(ids[b]): c for a, b, c in zip(i, j, s) if a == n} == {a: c for a, c in every.items() if c >= least}
    best, want = ann.Best(np.array([-np.inf, 0.5]), 3), {0: [], 1: []}
    for _ in range(9):
        n, a, c = rng.integers(0, 2, 30), rng.permutation(1000)[:30], rng.integers(0, 4, 30).astype(float)
        best.add(n, a, c)
        for y in (0, 1):
            want[y] += [(-z, int(w)) for w, z, m in zip(a, c, n) if m == y]
        assert best.held <= 12
    n, a, c = best.cut()
    for y in (0, 1):
        assert [(-z, int(w)) for w, z, m in zip(a, c, n) if m == y] == sorted(want[y])[:3]
        assert best.floor[y] == -sorted(want[y])[2][0]


def test_scan_grid():
    for asked, vectors, blocks, parts, dim in ((1, 1, 1, 8, 3), (30000, 600000, 1200, 25, 64), (30000, 600000, 1200, 600, 64), (5, 9, 2, 200, 4),
                                               (10**6, 2 * 10**7, 40000, 600, 64), (9000, 9000, 18, 8, 1536)):
        tall, wide = ann.scan_grid(asked, vectors, blocks, parts, dim)
        assert 1 <= tall <= asked and 1 <= wide <= blocks
        assert tall * wide >= min(parts, asked * blocks)
        assert tall == asked or asked / tall * dim * 8 <= 1 << 24
        assert asked * vectors / (tall * wide) <= 1 << 30
        assert asked * wide + vectors * tall <= 4 * (asked * vectors * tall * wide) ** 0.5 or wide == blocks or asked / tall * dim * 8 > 1 << 23


def test_scanned_queries_do_not_pass_through_the_driver(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = rng.permutation(len(x))
    df = frame(spark, ids, x)
    want = brute(ids, x.astype(float), ids.tolist(), 20)
    limits, key, parts = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize", "spark.sql.shuffle.partitions"
    before, n = limits.get(key, "1g"), spark.conf.get(parts)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    try:
        spark.conf.set(parts, "48")
        limits.set(key, "4m")
        rows = ann.nearest(df, F.lit(True), block=32).collect()
    finally:
        limits.set(key, before)
        spark.conf.set(parts, n)
    got = rows_of(rows)
    scanned = {r.query_id for r in rows if r.scanned}
    assert len(scanned) > 1000 and set(got) == set(want)
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in scanned)
