import random
import re
from collections import Counter, defaultdict

from trajens.llm import mixing


def brute_targets(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    """Share by weight; whatever stands above its cap stops there; again with the rest."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        per = left / sum(w[s] for s in free)
        over = [s for s in free if per * w[s] > cap * sizes[s]]
        if not over:
            return out | {s: per * w[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, key string, n_chars long")


def make(rng, n):
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "c", "é", "z", None])
        words = rng.choice([0, 1, 3, 10, 50, 400])
        text = None if rng.random() < 0.02 else " ".join(["w"] * words)
        rows.append((i, text, source, 1, "k", 0))
    return rows


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(rows, got):
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += words(t)
    want = brute_targets(dict(sizes))
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-9 * (1 + want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, words(t)) for d, t, *_ in rows)


def test_targets_and_taken_words(spark):
    rows = make(random.Random(1), 600)
    got = mixing.mix(docs_of(spark, rows)).collect()
    check(rows, got)
    again = mixing.mix(docs_of(spark, rows).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    # rates tilt exponentially in size: log rate / size is one number per source below the cap
    import math
    for s in {r.source for r in got}:
        slopes = [math.log(r.rate) / r.size for r in got if r.source == s and r.size and r.rate < 2]
        assert not slopes or max(slopes) - min(slopes) < 1e-9
    # only one document of a source is cut
    for s in {r.source for r in got}:
        assert sum(1 for r in got if r.source == s and r.size and r.taken % r.size) <= 1


def test_edge_tables(spark):
    for rows in ([(1, None, None, 1, "", 0)], [(1, "a b", "x", 1, "", 0)], [(1, "", "x", 1, "", 0), (2, "w w", "y", 1, "", 0)],
                 [(None, "a b c", "x", 1, "", 0)] * 7 + [(1, " \n", None, 1, "", 0)]):
        check(rows, mixing.mix(docs_of(spark, rows)).collect())
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_mixed_documents_hold_the_taken_words(spark):
    rng = random.Random(2)
    rows = [(i, "  " + " \n".join(f"w{j}" for j in range(rng.choice([0, 1, 5, 30]))) + " ", rng.choice(["a", "b", None]), 1, "k", 0)
            for i in range(120)] + [(5, "twice here", "a", 1, "k", 0)] * 2
    df = docs_of(spark, rows)
    plan = mixing.mix(df).collect()
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = defaultdict(int)
    by_id = defaultdict(list)
    for d, t, *_ in rows:
        by_id[d].append(t)
    for r in out.collect():
        got[r.doc_id] += words(r.text)
        assert any(t == r.text or t.startswith(r.text) for t in by_id[r.doc_id])
    want = defaultdict(int)
    for r in plan:
        want[r.doc_id] += r.taken
    assert {d: n for d, n in want.items() if n} == dict(got)
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_op2_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, mixing.op2_mixing(spark, sf).collect())
