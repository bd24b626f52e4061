import random
import re
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from trajens.llm import audit as A

SCHEMA = "doc_id long, text string, lang string, part string, mask int"
LABELS = "doc_id long, quality int, toxic int"


def failures(docs):
    """Per row, the set of filters it fails, straight from the contract."""
    for i, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = set()
        if len(w) < 200:
            out.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            out.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            out.add("C")
        if re.search(r"[#$%&*|]", t):
            out.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in docs):
            out.add("E")
        yield i, lang or "", out


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = list(failures(docs))
    out, shapley = [], {}
    for part in {p for _, p, _ in rows}:
        own = [(i, f) for i, p, f in rows if p == part]
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                before = len([x for x in own if f in x[1]]) - len(gone)
                left = [x for x in left if f not in x[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), before,
                            sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def fixture():
    rng = random.Random(11)
    docs = []
    for i in range(160):
        n = rng.choice([0, 3, 150, 199, 200, 201, 260])
        words = [rng.choice(["Ab", "cd", "e"]) + str(rng.randrange(rng.choice([40, 4000]))) for _ in range(n)]
        if rng.random() < 0.2:
            words.append(rng.choice(["#", "a|b", "100%", "&", "*", "$"]))
        docs.append((i, rng.choice([" ", "\n", "\x0b"]).join(words), rng.choice(["en", "de", None, ""]), "p", 1))
    docs += [(rng.randrange(300), docs[k][1], rng.choice(["en", "fr", None]), "p", 2) for k in range(0, 160, 3)]
    docs += [(None, docs[4][1], "en", "p", 3), (None, docs[4][1], "de", "p", 3), (500, None, "en", "p", 3), (501, None, None, "p", 3),
             (None, None, "en", "p", 3), (7, docs[7][1], docs[7][2], "p", 0), (502, "Éİ a b", "en", "p", 3),
             (503, "A" * 3 + "b" * 97, "fr", "p", 1), (504, "A" * 4 + "b" * 96, "fr", "p", 1)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 320, 2)]
    labels += [(10, 0, 1), (10, 1, 0), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    docs, labels = fixture()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    q = A.op12_filter_audit(spark, str(tmp_path))
    got = sorted(tuple(r) for r in q.collect())
    assert got == brute(docs, labels)
    assert dict(q.dtypes) == {"part": "string", "filter_order": "string", "step": "int", **dict.fromkeys(
        ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"], "bigint")}
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    r = con.sql(A.OP12_SQL)
    assert r.columns == q.columns and sorted(r.fetchall()) == got


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert A.op12_filter_audit(spark, str(tmp_path)).count() == 0


def test_hot_text_and_other_filters(spark):
    n = 3000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("same words").alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionByName(docs)  # each row twice: ids tie
    labels = spark.createDataFrame([], LABELS)
    counts = A.failure_counts(docs, labels, {"x": F.col("doc_id") % 3 == 0}, "xyz", duplicate="z")
    assert sorted(tuple(r)[:3] for r in counts.where("n > 0").collect()) == [
        ("en", 1, 2), ("en", 4, 2 * (n - n // 3)), ("en", 5, 2 * (n // 3 - 1))]
    steps = A.order_steps(A.coalition_games(counts, 3), "xyz")
    assert steps.count() == 18
    # the Shapley values of all filters add up to the removals of all orders
    for order in ("xyz", "zyx"):
        rows = steps.where(F.col("filter_order") == order).collect()
        assert sum(r.shapley for r in rows) == 6 * sum(r.removed for r in rows) and sum(r.removed for r in rows) == 2 * n
    plain = A.failure_counts(docs, labels, {"x": F.lit(False)}, "x")
    assert [tuple(r)[:3] for r in plain.where("n > 0").collect()] == [("en", 0, 2 * n)]


def test_potential_of_a_known_game(spark):
    """Filters 0 and 1 fail together on 6 documents, filter 2 alone on 4: values 3, 3, 4."""
    counts = spark.createDataFrame([("p", 3, 6, 1, 0), ("p", 4, 4, 0, 2), ("p", 0, 5, 5, 5)], "part string, mask int, n long, good long, toxic long")
    g = A.coalition_games(counts, 3).collect()[0]
    assert list(g.v_n) == [0, 6, 6, 6, 4, 10, 10, 10] and g.total == 15
    assert [g.potential[7] - g.potential[7 - b] for b in (1, 2, 4)] == [18, 18, 24]
    assert list(g.v_good)[7] == 1 and list(g.v_toxic)[4] == 2
