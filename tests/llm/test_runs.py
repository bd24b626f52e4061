import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trajens.llm import runs as R


def brute(w, least=6, exponent=4):
    """Every maximal stretch of every period, kept where no smaller period holds in it."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, exponent * q):
                part = w[i:i + length]
                if not any(all(part[x] == part[x + p] for x in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, rewrite=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if rewrite and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute(w)
    best = None
    for s, k, q in found:
        if best is None or k * best[2] > best[1] * q:
            best = (s, k, q)
    drop = {i for s, k, q in found for i in range(s + q, s + k)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            digest("".join(f"{s},{k},{q}\n" for s, k, q in found)),
            digest(" ".join(x for i, x in enumerate(w) if i not in drop)))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_all_runs_of_short_words(w):
    assert R.find_runs(w) == brute(w)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=14), st.integers(1, 12)), max_size=6))
def test_planted_powers(parts):
    w = [x for unit, times in parts for x in unit * times]
    assert R.find_runs(w) == brute(w)


def test_hard_words():
    fib, prev = [0], [1]
    while len(fib) < 400:
        fib, prev = fib + prev, fib
    thue = [bin(i).count("1") & 1 for i in range(512)]
    ramp = [0] * 200 + [1] + [0] * 200 + [1] + [0] * 77
    nested = ([0, 1] * 9 + [2]) * 11 + [0, 1] * 9
    for w in (fib, thue, ramp, nested, [7] * 300, list(range(50)) * 7, [0, 0, 1] * 50 + [0, 0, 2] * 50):
        assert R.find_runs(w) == brute(w)
    rng = random.Random(5)
    for q in range(1, 130):  # every period, at any place
        unit = [rng.randrange(10 ** 6) for _ in range(q)]
        at, length = rng.randrange(200), max(6, 4 * q) + rng.randrange(q)
        w = [-i - 1 for i in range(at)] + [unit[i % q] for i in range(length)] + [-1000 - i for i in range(9)]
        assert R.find_runs(w) == [(at, length, q)]


def test_online_and_weaker_runs():
    c = R.SquareCatcher(min_length=10, min_exponent=5)
    w = [1, 2] * 6 + [3] + [4] * 9
    for i, x in enumerate(w):
        c.append(x)
        assert c.runs() == [r for r in brute(w[:i + 1], 10, 5)]
    with pytest.raises(ValueError):
        R.find_runs(w, min_exponent=3)


def test_operator_edge_cases(spark):
    rows = [(1, None, "a"), (1, "", "b"), (2, " \t\n", "c"), (None, "x " * 8, "d"), (3, "x " * 8, "d"), (3, "x " * 8, "d"),
            (4, "tick tock " * 5 + "end", "e"), (6, "tick\u00a0tock " * 6, "g"), (5, " ".join(f"w{i % 97}" for i in range(40_000)), "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = R.periodic_runs(df)
    assert got.columns == ["doc_id", "text", "runs", "n_words", "_runs", "collapsed"]
    by = {(r.doc_id, r.runs): r for r in got.collect()}
    assert (by[1, "a"].n_words, by[1, "a"]._runs, by[1, "a"].collapsed) == (0, [], None)
    assert by[1, "b"].collapsed == "" and by[2, "c"].collapsed == ""
    assert by[None, "d"].collapsed == "x" and [tuple(x) for x in by[3, "d"]._runs] == [(0, 8, 1)]
    assert [tuple(x) for x in by[4, "e"]._runs] == [(0, 10, 2)] and by[4, "e"].collapsed == "tick tock end"
    assert [tuple(x) for x in by[6, "g"]._runs] == [(0, 6, 1)]  # a no-break space parts no words
    assert [tuple(x) for x in by[5, "f"]._runs] == [(0, 40_000, 97)]
    assert got.count() == len(rows) and R.periodic_runs(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        n = rng.choice([0, 1, 2, 5, 9, 30, 120, 260])
        words = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(n)]
        if n > 20 and i % 3 == 0:
            at, unit = rng.randrange(n), words[:rng.randint(1, 4)]
            words[at:at] = unit * rng.randint(3, 9)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words) if i % 50 else None))
    rows += [(None, "a " * 9), (7, rows[7][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = R.op11_periodic_runs(spark, str(tmp_path))
    want = [expected(*r) for r in rows]
    key = lambda t: tuple((x is None, str(x)) for x in t)
    assert sorted((tuple(r)[:8] for r in got.collect()), key=key) == sorted(want, key=key)
    assert sum(w[1] > 0 for w in want) > 40
