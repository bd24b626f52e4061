import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as C
from trajens.llm import langid, mixing, pii, tokens
from tests.llm.test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"
KEY = b"a key for this test alone"


def test_stages_in_order_keep_the_columns_and_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "configured_key", lambda _: KEY)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["language", "near_dedup", "private_data", "mixture", "packing"]
    outs, at = [], docs
    for name, stage in C.STAGES[:-1]:
        at = C.store(stage(spark, at, SF), f"test-{name}")
        assert at.columns == docs.columns
        outs.append({r.doc_id: r for r in at.collect()} if name != "mixture" else at.collect())
    language, dedup, private, mixed = outs
    before = {r.doc_id: r for r in docs.collect()}
    said = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert set(language) == {d for d, r in said.items() if r.lang_pred != "und" and not r.ambiguous}
    assert all(language[d] == before[d] for d in language)
    comps = brute_components([(d, brute_fp(r.text)) for d, r in language.items()])
    assert set(dedup) == {c for *_, c in comps}
    assert {d: r.text for d, r in private.items()} == {d: pii.pseudonymized(r.text, KEY)[0] for d, r in dedup.items()}
    taken = {}
    for r in mixed:
        assert private[r.doc_id].text.startswith(r.text) and r.n_chars == len(r.text)
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    plan = mixing.mix(spark.createDataFrame(list(private.values()), docs.schema)).collect()
    assert taken == {r.doc_id: r.taken for r in plan if r.taken}
    pieces = C.packing(spark, at, SF).collect()
    lib = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    ids = {r.text: [*lib.encode(r.text, add_special_tokens=False).ids, 1] for r in mixed}
    assert sum(r.length for r in pieces) == sum(len(ids[r.text]) for r in mixed)
    assert sorted(r.doc_tokens for r in pieces if r.start == 0) == sorted(len(ids[r.text]) for r in mixed)
    crc = {(r.doc_id, len(ids[r.text])): ids[r.text] for r in mixed}
    for p in pieces:
        own = crc[p.doc_id, p.doc_tokens][p.start:p.start + p.length]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == p.ids_crc32


def test_run_gives_the_last_stage(spark):
    got = C.run(spark, SF).collect()
    total = sum(r.length for r in got)
    assert {r.sequence_id for r in got} == set(range(-(-total // 2048)))


def test_empty_input(spark):
    at = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        at = stage(spark, at, SF)
        assert at.count() == 0
