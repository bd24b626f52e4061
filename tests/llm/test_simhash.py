import random
from itertools import combinations

import numpy as np
import xxhash

from trajens.llm import graph, simhash


def brute_fp(text):
    import re
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    sh = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs):
    """pairs: [(doc_id, fp)]; {doc_id: smallest reachable}"""
    comp = {f: f for _, f in pairs}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for a, b in combinations(sorted(comp), 2):
        if (a ^ b).bit_count() <= 2:
            comp[find(a)] = find(b)
    low = {}
    for d, f in pairs:
        r = find(f)
        low[r] = d if low.get(r) is None else low[r] if d is None else min(d, low[r])
    return sorted(((d, f, low[find(f)]) for d, f in pairs), key=str)


def test_fingerprint_matches_the_definition():
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "one TWO", "É é A b c", "a b c d\x1ce f"] + [
        " ".join(rng.choice("ab cd ef gh Zz ÄÖ".split()) for _ in range(n)) for n in (3, 4, 5, 50, 3000)]
    for t in texts:
        assert simhash.simhash64(t.encode() if t else None) == brute_fp(t)


def test_plan_covers_the_radius():
    rng = np.random.default_rng(2)
    for fps in (rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2), np.arange(300, dtype=np.uint64), np.zeros(1, np.uint64)):
        for radius in (1, 2, 3):
            parts = simhash.plan(fps, 10_000, radius)
            assert sum(t + 1 for _, t in parts) == radius + 1
            bits = [b for g, _ in parts for b in g]
            assert len(bits) == len(set(bits))


def cloud(rng, n, centres=3, flips=4):
    cs = [rng.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        x = rng.choice(cs)
        for b in rng.sample(range(64), rng.randint(0, flips)):
            x ^= 1 << b
        out.add(x)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def test_links_span_all_near_pairs(spark):
    rng = random.Random(4)
    fps = cloud(rng, 400) + [rng.getrandbits(63) for _ in range(100)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for hot in (0, 5, 10_000):
        cc = {r.node: r.root for r in graph.components(simhash.links(df, 2, 256, hot)).collect()}
        want = brute_components([(i, f & (2**64 - 1)) for i, f in enumerate(fps)])
        group = {}
        for i, f in enumerate(fps):
            group.setdefault(cc.get(f, f), []).append(i)
        brute = {}
        for d, _, c in want:
            brute.setdefault(c, []).append(d)
        assert sorted(map(sorted, group.values())) == sorted(map(sorted, brute.values()))


def test_operator_against_brute_force(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choice("ab cd ef gh ij kl mn op".split()) for _ in range(60)) for _ in range(30)]
    texts = base + [t + " zz" for t in base] + base[:5] + [None, "", "x", "X", "y z"]
    rows = [(1000 - i, t, "a", 3) for i, t in enumerate(texts)] + [(None, base[0], "a", 3), (1000, base[0], "a", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, node int")
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_groups(df, hot_bucket=2).collect()), key=str)
    want = brute_components([(d, brute_fp(t)) for d, t, *_ in rows])
    assert got == want
    kept = simhash.keep_one_per_group(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    known = brute_components([(d, brute_fp(t)) for d, t, *_ in rows if d is not None])
    assert ids == sorted({c for *_, c in known})
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_op9_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, brute_fp(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.op9_simhash(spark, sf).collect()), key=str)
    assert got == brute_components(docs)


def test_one_row_stays_per_component_where_ids_repeat_or_lack(spark):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) for _ in range(60))
    texts = [text() for _ in range(8)]
    rows = [(5, texts[0]), (5, texts[1]), (3, texts[1]), (5, texts[2]), (5, texts[2]), (None, texts[2]), (None, texts[3]), (None, texts[3]),
            (None, texts[4]), (7, texts[4].upper()), (8, texts[5]), (8, texts[6]), (8, texts[5]), (9, None), (None, "")]
    df = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(rows)], "_id int, doc_id long, text string")
    out = simhash.keep_one_per_group(df, hot_bucket=2)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = [(5, texts[0]), (3, texts[1]), (5, texts[2]), (None, texts[3]), (7, texts[4].upper()), (8, texts[5]), (8, texts[6]), (9, None)]
    assert got == sorted(want, key=str)
