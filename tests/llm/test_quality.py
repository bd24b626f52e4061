import random
import re
from fractions import Fraction
from math import comb

from pyspark.sql import functions as F

from trajens.llm import quality as Q


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    covered = {p + j for at in seen.values() if len(at) > 1 for p in at for j in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(lines), len(covered))


TEXTS = [None, "", " \n\t", "a", "a b c d e", "a a a a a a", "x y z w v x y z w v", "l1\nl1\n l1\n\n \nl2\r\nl2\r\n", "é # ** $%&|<> ß\x1cq\x85r",
         "a b c d e f a b c d e g a b c d e", "\x0b\x0ca\x0bb\x0c"]
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def test_measures_match_brute_force(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(["a ", "b ", "c\n", "dd ", " ", "#", "e\t"]) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, words int")
    for r in Q.measures(df).collect():
        assert tuple(r[f] for f in FIELDS) == brute(texts[r.doc_id]), texts[r.doc_id]
    assert Q.measures(df.limit(0)).count() == 0


def test_exact_binomial_bound(spark):
    def most(n, alpha, level):
        c, k = 0.0, -1
        for i in range(int(n * alpha) + 1):
            c += comb(n, i) * alpha**i * (1 - alpha)**(n - i)
            if c > level:
                break
            k = i
        return k
    ns = [0, 1, 10, 100, 300, 500, 1000]
    for alpha, level in ((0.01, 0.004), (0.05, 0.05), (0.2, 0.001)):
        got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", Q.most_allowed(F.col("n"), alpha, level).alias("k")).collect()
        assert [r.k for r in got] == [most(n, alpha, level) for n in ns]


def corpus(spark, n=6000, seed=2):
    rng, rows, marks = random.Random(seed), [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = ["w" + str(rng.randint(0, 9999)) for _ in range(rng.choice([20, 120]))]
        if not good:
            words = [w + "###" for w in words]
        elif rng.random() < 0.3:
            words[0] += "#"
        rows.append((i, " ".join(words), good))
        marks.append((i, int(good), 0))
    return (spark.createDataFrame(rows, "doc_id long, text string, good boolean"),
            spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))


def test_thresholds_hold_the_risk_and_catch_junk(spark):
    docs, labels = corpus(spark)
    risk = Q.Risk()
    got = Q.quality(docs, labels, risk).join(docs.select("doc_id", "good"), "doc_id").collect()
    good, junk = [r for r in got if r.good], [r for r in got if not r.good]
    assert sum(r.kept for r in junk) == 0
    for s in {r.stratum for r in good}:
        own = [r for r in good if r.stratum == s]
        assert sum(not r.kept for r in own) <= risk.alpha * len(own)


def test_few_labels_certify_nothing(spark):
    docs, labels = corpus(spark, 200)
    got = Q.quality(docs, labels).collect()
    assert all(r.kept != r.base_failed and not r.rejected_by for r in got)
    assert Q.quality(docs, labels.limit(0)).where("kept").count() == sum(not r.base_failed for r in got)


def test_null_repeated_and_conflicting_labels(spark):
    docs, labels = corpus(spark, 400)
    odd = spark.createDataFrame([(None, 1, 0), (0, None, 0), (0, 0, 0), (0, 1, 1), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    extra = spark.createDataFrame([(None, "a b c", True), (0, "x y", True), (0, "x y", True)], "doc_id long, text string, good boolean")
    both = docs.unionByName(extra)
    got = Q.quality(both, labels.unionByName(odd)).collect()
    assert len(got) == 403 and all(r.base_failed for r in got if r.n_words < 10)


def test_op7_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = Q.op7_quality(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        b = brute(texts[r.doc_id])
        assert tuple(r[f] for f in FIELDS) == b
        assert r.base_failed == (b[0] < 10 or 100 * b[5] > 20 * b[0]) and not (r.kept and r.base_failed)


def test_copies_of_a_labelled_row_are_no_trials(spark):
    """Each label fifty times over, and each row: the cutoffs are those of one row per id."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(30)) + " #" * (i % 7 == 0)) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(700)], "doc_id long, quality int")
    many = lambda df: df.crossJoin(spark.range(50).select()).select(*df.columns)
    key = lambda t: sorted(tuple(r) for r in t.collect())
    once = key(Q.thresholds(Q.measures(docs), labels, Q.Risk(alpha=0.2)))
    assert once and once == key(Q.thresholds(Q.measures(many(docs)), many(labels), Q.Risk(alpha=0.2)))
