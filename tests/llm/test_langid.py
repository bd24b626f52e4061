import zlib

import numpy as np
from pyspark.sql import functions as F

from trajens.llm import langid as L

WORDS = {"en": "the of and with that this from which", "de": "der die und mit dass diese von welche über",
         "fr": "le la et avec que cette depuis laquelle été", "es": "el los y con que esta desde cual año"}


def corpus(spark, n=800, extra=()):
    rng, rows = np.random.default_rng(1), []
    for i in range(n):
        lang = list(WORDS)[rng.integers(4)]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), rng.integers(4, 60))), lang, "s", 0.5))
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string, source string, score double")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_codewords():
    for n in (2, 3, 4, 7, 8, 20):
        m = L.codewords(n).astype(int)
        assert len({tuple(r) for r in m}) == n and (abs(m.sum(axis=0)) < n).all()
        far = (m.shape[1] - m @ m.T) // 2
        assert min(far[i][j] for i in range(n) for j in range(i)) >= max(1, m.shape[1] // 4)


def test_margins_do_not_depend_on_neighbours_or_slices(monkeypatch):
    rng = np.random.default_rng(3)
    model = L.fit({l: rng.integers(0, 50, 1 << 10).astype(float) for l in "abc"}, 1 << 10, 4.0, 0.02)
    texts = [b"", b"a", b"Hello there", "né à".encode(), b"x" * 3000, b"123 456"]
    alone = np.vstack([L.margins([t], model) for t in texts])
    assert np.allclose(L.margins(texts, model), alone)
    for t, f in zip(texts, alone):
        data = L.folded(t)
        bins = [L.trigram_bins(data[i:i + 3], 1 << 10)[0] for i in range(len(data) - 2)]
        assert np.allclose(f, model.weights[bins].astype(float).sum(axis=0) / max(1, len(data) - 2), atol=1e-5)
    monkeypatch.setattr(L, "_SLICE", 100)
    assert np.allclose(L.margins(texts, model), alone)


def test_held_out_accuracy_and_rows(spark):
    extra = [(2000, None, "en", None, None), (2001, "", "de", "s", 0.0), (2002, "12 34 !!", "fr", "s", 1.0), (None, "the of and", "en", "s", 1.0),
             (2003, "le la et avec", None, "s", 1.0), (2003, "le la et avec", None, "s", 1.0)]
    df = corpus(spark, extra=extra)
    model = L.train(df)
    assert model.langs == sorted(WORDS)
    got = L.identify(df, model).collect()
    assert len(got) == 806
    want = {r.doc_id: r.lang for r in df.collect()}
    out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 2000]
    assert len(out) > 100 and sum(r.lang_pred == want[r.doc_id] for r in out) / len(out) >= 0.98
    for r in got:
        assert 0 <= r.score <= 1 and (r.doc_id is None or r.held_out == held(r.doc_id))
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2000, 2001, 2002)) and by[2003].lang_pred == "fr"
    kept = L.accepted(df, model)
    assert kept.schema == df.schema and {2000, 2001, 2002}.isdisjoint({r.doc_id for r in kept.collect()})
    assert kept.count() >= 0.99 * 803


def test_prediction_reads_text_alone(spark):
    df = corpus(spark, 300)
    model = L.train(df)
    other = df.selectExpr("doc_id", "text", "'xx' as lang", "'other' as source", "score")
    a = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(df, model).collect()}
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in L.identify(other, model).collect()}


def test_no_or_one_language(spark):
    df = corpus(spark, 50)
    none = L.train(df.limit(0))
    assert {r.lang_pred for r in L.identify(df, none).collect()} == {"und"}
    assert L.identify(df.limit(0), none).count() == 0
    one = L.train(df.where("lang = 'de'"))
    assert {(r.lang_pred, r.score) for r in L.identify(df, one).collect()} == {("de", 1.0)}
    assert L.accepted(df, one).count() == 50


def test_op8_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = L.op8_langid(spark, sf).collect()
    assert len(got) == len(want)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == want[r.doc_id] for r in out) >= 0.95 * len(out)


def test_half_and_half_texts_are_ambiguous_and_clean_ones_are_not(spark):
    df = corpus(spark, 2000)
    model = L.train(df)
    clean = L.identify(df, model).collect()
    assert sum(r.ambiguous for r in clean) <= 0.005 * len(clean)
    rng, langs, half = np.random.default_rng(5), list(WORDS), []
    for i in range(200):
        a, b = rng.choice(4, 2, replace=False)
        half.append((i, " ".join(w for x in (a, b) for w in rng.choice(WORDS[langs[x]].split(), 100))))
    got = L.identify(spark.createDataFrame(half, "doc_id long, text string"), model).collect()
    assert sum(r.ambiguous for r in got) >= 0.1 * len(got)


def test_doubt_keeps_to_the_stated_rate():
    at = lambda g: int((np.log2(g) - L._LEAST_GAP) * L._GAP_BINS)
    counts = {at(0.01): 1, at(0.1): 4, at(8.0): 995}
    assert L.doubt_of(counts, 0.0) <= 0.01 < L.doubt_of(counts, 0.001) <= 0.1 < L.doubt_of(counts, 0.005) <= 0.8
    assert L.doubt_of({}, 0.001) is None and L.doubt_of({0: 10}, 0.001) == 0.0


def test_copies_of_a_text_are_sampled_each_for_itself(spark):
    df = spark.range(9000).selectExpr("'en' as lang", "cast(if(id % 3 = 0, 'one text', concat('text ', id)) as binary) as text", "id")
    for seed_rows in (300, 900, 1800):
        got = df.where(L.sampled(seed_rows, 9000))
        copies = got.where("cast(text as string) = 'one text'").count()
        assert 0.8 * seed_rows <= got.count() <= 1.2 * seed_rows and 0.2 * seed_rows <= copies <= 0.5 * seed_rows


def test_the_check_sample_is_not_counted(spark, monkeypatch):
    df = corpus(spark, 600).select("doc_id", "text", "lang")
    n = df.where(~L.held_out("doc_id")).count()
    odd = L.sampled(60, n)
    keyed = df.withColumn("id", F.col("doc_id")).withColumn("raw", F.col("text").cast("binary"))
    drawn = {r.doc_id for r in keyed.select("doc_id", "id", F.col("raw").alias("text")).where(odd & ~L.held_out("doc_id")).collect()}
    seen = {}
    fit = L.fit
    monkeypatch.setattr(L, "fit", lambda counts, *a: seen.update(counts) or fit(counts, *a))
    L.train(df, check_rows=60)
    want = {}
    for r in df.collect():
        if not held(r.doc_id) and r.doc_id not in drawn:
            bins = L.trigram_bins(L.folded(r.text.encode()), 1 << 14)
            want[r.lang] = want.get(r.lang, 0) + np.bincount(bins, minlength=1 << 14)
    assert 30 <= len(drawn) <= 120 and set(seen) == set(want) and all((seen[l] == want[l]).all() for l in want)


def test_a_language_with_all_its_texts_in_the_sample_is_learned(spark):
    df = corpus(spark, 400).select("doc_id", "text", "lang")
    n = df.where(~L.held_out("doc_id")).count() + 1
    text = "wir und ihr zusammen"
    raw = spark.range(10_000, 20_000).select(F.col("id"), F.lit(text).cast("binary").alias("text"))
    rare = next(r.id for r in raw.where(L.sampled(4000, n)).orderBy("id").collect() if not held(r.id))
    model = L.train(df.unionByName(spark.createDataFrame([(rare, text, "xx")], df.schema)))
    assert "xx" in model.langs
    got = L.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert got.lang_pred == "xx"
