import random
import zlib
from collections import Counter

from trajens.llm import sharding


def rows_of(spark, n):
    rows = [(i, f"text {i}" if i % 7 else None, "x", i) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, k1 int")


def check(got, n):
    per = Counter(r.shard for r in got)
    assert len(got) == n and max(per.values()) - min(per.get(j, 0) for j in range(8)) <= 1
    for j, c in per.items():
        assert sorted(r.slot for r in got if r.shard == j) == list(range(c))


def test_exact_sizes_gapless_slots_and_rerun(spark):
    df = rows_of(spark, 1003)
    got = sharding.shuffle_to_shards(df, least_blocks=16).collect()
    check(got, 1003)
    again = sharding.shuffle_to_shards(df.repartition(7), least_blocks=16).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    for r in got:
        t = (f"text {r.doc_id}" if r.doc_id % 7 else "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))


def test_null_and_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(None, None)] * 5 + [(1, "a")] * 40 + [(2, "")], "doc_id long, text string")
    check(sharding.shuffle_to_shards(df).collect(), 46)
    assert sharding.shuffle_to_shards(df.limit(0)).count() == 0
    few = sharding.shuffle_to_shards(df.limit(3)).collect()
    assert sorted(r.shard for r in few) == [0, 1, 2] and {r.slot for r in few} == {0}


def test_copies_fill_no_block(spark, monkeypatch):
    # a third of the rows is one row, another sixth one with a null id
    df = spark.createDataFrame([(7, "same")] * 2000 + [(None, "")] * 1000 + [(i, f"text {i}") for i in range(100, 3100)],
                               "doc_id long, text string").repartition(6)
    made = {}
    keep = sharding.store
    monkeypatch.setattr(sharding, "store", lambda d, name: made.setdefault(name, keep(d, name)))
    monkeypatch.setattr(sharding, "MATRIX_SLICE", 5)
    cut = sharding.matrix_table
    monkeypatch.setattr(sharding, "matrix_table", lambda s, b, m: made.setdefault("sizes", [sum(r) for r in m]) and cut(s, b, m))
    got = sharding.shuffle_to_shards(df, least_blocks=16).collect()
    check(got, 6000)
    assert max(made["sizes"]) < 2 * 6000 / 16 and len(made["sizes"]) == 16
    subs = [r["count"] for r in made["shard-sent"].groupBy("shard", "sub").count().collect()]
    assert max(subs) < 2.5 * 6000 / (8 * 16)
    assert sum(r.doc_id == 7 for r in got) == 2000 and sum(r.doc_id is None for r in got) == 1000
    per = Counter(r.shard for r in got if r.doc_id == 7)
    assert min(per.values()) > 180 and max(per.values()) < 320


def test_hypergeometric_law():
    rng = random.Random(1)
    n, good, bad, draws = 20000, 30, 50, 20
    got = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(n))
    from math import comb
    for k in range(21):
        p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
        assert abs(got[k] / n - p) < 5 * (p / n) ** 0.5 + 1e-3


def test_matrix_margins():
    m = sharding.communication_matrix([5, 0, 100, 7], [14, 14, 14, 14, 14, 14, 14, 14], 3)
    assert [sum(r) for r in m] == [5, 0, 100, 7] and [sum(c) for c in zip(*m)] == [14] * 8


def test_places_look_uniform(spark):
    got = sharding.shuffle_to_shards(rows_of(spark, 4000), least_blocks=16).collect()
    per = [Counter() for _ in range(8)]
    for r in got:
        per[r.shard][r.doc_id // 500] += 1
    chi = sum((per[j][b] - 62.5) ** 2 / 62.5 for j in range(8) for b in range(8))
    assert chi < 100  # 49 degrees of freedom
    slope = sum((r.slot - 249.5) * (r.doc_id - 1999.5) for r in got)
    norm = (sum((r.slot - 249.5) ** 2 for r in got) * sum((r.doc_id - 1999.5) ** 2 for r in got)) ** 0.5
    assert abs(slope / norm) < 0.06
