import hashlib
import random

import numpy as np

from trajens.llm import substrings


def brute(rows, length):
    """rows: [(order, id, bytes)] -> sorted [(id, n_bytes, n_removed, n_spans, sha)]"""
    first = {}
    for o, _, t in sorted(rows, key=lambda r: r[0]):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p:p + length], (o, p))
    out = []
    for o, i, t in rows:
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - length + 1):
            if first[t[p:p + length]] < (o, p):
                gone[p + 1:p + length + 1] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        left = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def text(rng, n):
    return " ".join(rng.choice("ab cd ef gh ij klm né 漢字".split()) + str(rng.randint(0, 99)) for _ in range(n))


def test_runs_hold_every_start_once_and_equal_strings_share_keys():
    rng = random.Random(1)
    a = text(rng, 200).encode()
    b = text(rng, 30).encode() + a[100:700] + text(rng, 30).encode()
    for data in (a, b, b"x" * 500, a[:100], a[:99], b""):
        key, span, s, n = substrings.runs(data, 100, 24)
        starts = [p for x, m in zip(s.tolist(), n.tolist()) for p in range(x, x + m)]
        assert starts == list(range(max(0, len(data) - 99)))
    places = {}
    for data in (a, b):
        key, _, s, n = substrings.runs(data, 100, 24)
        for k, x, m in zip(key.tolist(), s.tolist(), n.tolist()):
            for p in range(x, x + m):
                places.setdefault(data[p:p + 100], set()).add(k)
    assert all(len(v) == 1 for v in places.values())


def test_slices_hold_every_start_once(monkeypatch):
    data = text(random.Random(2), 900).encode()
    monkeypatch.setattr(substrings, "_SLICE", 512)
    _, _, s, n = substrings.runs(data, 100, 24)
    assert [p for x, m in zip(s.tolist(), n.tolist()) for p in range(x, x + m)] == list(range(len(data) - 99))


def test_string_hashes_depend_on_the_string_alone():
    rng = random.Random(5)
    a = text(rng, 60).encode()
    spans = [a[:160], b"zz" + a[20:150], a[10:110]]
    n = np.array([61, 33, 1])
    h, i, off = substrings.strings(spans, n, 100)
    seen = {}
    for x, k, o in zip(h.tolist(), i.tolist(), off.tolist()):
        assert seen.setdefault(x, spans[k][o:o + 100]) == spans[k][o:o + 100]
    assert len(h) == 95 and len(seen) == len({spans[k][o:o + 100] for k, o in zip(i, off)})


def test_later_copies_leave_the_first_place():
    key, span = np.array([5, 5, 5, 7, 5]), np.array([1, 1, 2, 1, 1])
    doc, s = np.array([9, 3, 3, 1, 3]), np.array([0, 8, 8, 0, 8])
    assert substrings.later_copies(key, span, doc, s).tolist() == [True, False, False, False, False]


def make(rng):
    base = [text(rng, 60) for _ in range(12)]
    passage = text(rng, 25)
    docs = list(base)
    docs += [b[:150] + passage + b[150:] for b in base]         # common passage, mixed edges
    docs += [b[:200] + "CHANGED" + b[200:] for b in base[:6]]   # near copies
    docs += base[:4] + ["z" * 400, "ab" * 200, None, "", "short", passage * 3]
    rng.shuffle(docs)
    return docs


def got_rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    docs = make(rng)
    ids = rng.sample(range(-50, 1000), len(docs))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, docs)], "doc_id long, text string, span string, n int")
    want = brute([(i, i, (t or "").encode()) for i, t in zip(ids, docs)], 100)
    for batches, group_rows in ((1, 10_000), (5, 10_000), (2, 0), (3, 4)):
        assert got_rows(substrings.remove_repeats(df, batches=batches, group_rows=group_rows)) == want
    kept = substrings.remove_repeats(df, with_text=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in kept)


def test_null_and_repeated_ids(spark):
    rng = random.Random(4)
    docs = make(rng)
    rows = [(i // 3 if i % 7 else None, t) for i, t in enumerate(docs)] + [(0, docs[0]), (0, docs[0]), (None, docs[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = df.selectExpr("doc_id", "text", "xxhash64(cast(text as binary)) h").collect()
    order = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.h if r.text is not None else 0)
    want = brute([(order(r), r.doc_id, (r.text or "").encode()) for r in hashed], 100)
    assert got_rows(substrings.remove_repeats(df, batches=3)) == want
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_op1_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got_rows(substrings.op1_suffix_dedup(spark, sf)) == brute(rows, 100)
