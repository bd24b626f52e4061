import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trajens.llm import packing, tokens

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = ["", " ", "  a", "a  b", "a\n b", "a \n\n b ", "it's <|endoftext|>x<|endoftext|> y", "  b   c",
       "\x1c a\x1d  b", "naïve Ünïcode 漢字 かな 123 45,6!", "é é́", "ΑΣ ας Σ", "İstanbul", "<|startoftext|> z",
       "a\tb\r\nc\x0bd\x0ce", "word" * 50, "The. the, THE., J\u030c, A\u0300. 3, x., y,. <|STARTOFTEXT|>, it's, 's.", "  x  y", "x" * 300 + " " * 300 + "y"]


def lib(name):
    return Tokenizer.from_file(tokens.tokenizer_path(name))


def random_text(rng, n):
    parts = ["the", "of", "it's", "123", "!!", " ", "  ", "\n", "\n\n ", "é", "漢字", "<|endoftext|>", "a1b2", " ", "ing"]
    return "".join(rng.choice(parts) + rng.choice(["", " ", " ", " "]) for _ in range(n))


def test_pieces_give_the_library_tokens():
    rng = random.Random(3)
    texts = ODD + [random_text(rng, 60) for _ in range(400)]
    b, w = lib(BYTE), lib(WORD)
    counts = tokens.text_counts(tokens.piece_counts(BYTE), texts + [None])
    ids = tokens.text_ids(tokens.piece_ids(WORD), [t.encode() for t in texts] + [None], b"\1\0")
    for t, n, i in zip(texts + [""], counts, ids):
        assert n == len(b.encode(t, add_special_tokens=False).ids), t
        assert np.frombuffer(i, "<u2").tolist() == [*w.encode(t, add_special_tokens=False).ids, 1], t


def test_piece_table_stays_bounded():
    t = tokens.PieceTable(BYTE, len, room=10)
    for i in range(100):
        assert t.look_up([f"w{i}", f"v{i}.", "the", "the,"])[2:] == [1, 2]
        assert len(t.young) <= 5 and len(t.old) <= 5


class Recorder:
    """The library's tokenizer, noting how many texts it is given."""

    def __init__(self, lib):
        self.lib, self.model, self.given = lib, lib.model, 0

    def get_vocab(self, **kw):
        return self.lib.get_vocab(**kw)

    def encode_batch_fast(self, texts, **kw):
        self.given += len(texts)
        return self.lib.encode_batch_fast(texts, **kw)


def test_new_words_reach_the_library_joined(monkeypatch):
    rng, w = random.Random(8), lib(WORD)
    words = ["".join(rng.choices("abcdeéñжß", k=7)) + "e" for _ in range(3000)]
    texts = [" ".join(x + rng.choice(["", "", ".", ",", "***", '?"']) for x in words[at:at + 30]) for at in range(0, 3000, 10)]
    record = Recorder(w)
    monkeypatch.setattr(tokens, "tokenizer", lambda path: record)
    ids = tokens.text_ids(tokens.piece_ids.__wrapped__(WORD), [t.encode() for t in texts], b"\1\0")
    want = w.encode_batch_fast(texts, add_special_tokens=False)
    assert [np.frombuffer(i, "<u2").tolist() for i in ids] == [[*e.ids, 1] for e in want]
    assert record.given < len(words) // 10, record.given


@pytest.mark.parametrize("room,joined", [(20, 3), (400, 7), (800_000, 32)])
def test_id_table_is_exact_and_bounded(room, joined):
    rng, w = random.Random(room), lib(WORD)
    parts = ["th", "The", "'", "'s", "'S", "''", "!", "?.", "***", "<|endoftext|>", "<|ENDOFTEXT|>", "|>", "<|", ",", ".", ")", "(",
             "1", "23", "é", "\u0301", "\u0338", "Σ", "İ", "ß", "漢", "\x1c", "\x85", "\xa0", "²", "\0", "-", "=", "J\u030c", "x" * 70]
    space = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c"]
    texts = ["".join(rng.choice(parts if rng.random() < .75 else space) for _ in range(rng.randrange(30))) for _ in range(1500)]
    t, got = tokens.IdTable(WORD, room=room, joined=joined), []
    for at in range(0, len(texts), 50):
        got += tokens.text_ids(t, [x.encode() for x in texts[at:at + 50]], b"\1\0")
        assert len(t.young) == len(t.young_ids) <= room // 2 and len(t.old) == len(t.old_ids) <= room // 2
        assert all(len(x) <= 64 for x in t.young)
    for x, g in zip(texts, got):
        assert np.frombuffer(g, "<u2").tolist() == [*w.encode(x, add_special_tokens=False).ids, 1], x
    assert len(got) == len(texts) and tokens.text_ids(t, [], b"\1\0") == []


def test_a_slice_of_a_column():
    texts = ["zero Zero.", "", "a", "B, ", " c", "d"]
    column = pa.array([t.encode() for t in texts], pa.large_binary()).slice(2, 3)
    ids = tokens.joined_ids(tokens.piece_ids(WORD), column, b"\1\0").to_pylist()
    assert ids == tokens.text_ids(tokens.piece_ids(WORD), [t.encode() for t in texts], b"\1\0")[2:5]
    assert list(tokens.byte_slices(column, 2)) == [(0, 2), (2, 3)]


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (100, 90), (200, 100), (500, 70)])
def test_resynchronisation_in_one_task(chunk, overlap):
    rng, b = random.Random(chunk), lib(BYTE)
    texts = [random_text(rng, 300) for _ in range(20)] + ["x" * 1500, " " * 1500, "<|endoftext|>" * 80, "a" * 700 + " b" * 300]
    for t in texts:
        assert tokens.resynchronised(BYTE, t, chunk, overlap) == len(b.encode(t, add_special_tokens=False).ids)


def test_work_on_a_text_without_boundaries_is_linear(monkeypatch):
    encoded, plain = [], tokens.piece_starts
    monkeypatch.setattr(tokens, "piece_starts", lambda name, text, at, stop: encoded.append(len(text)) or plain(name, text, at, stop))
    b = lib(BYTE)
    head = "some words " * 300
    for t in ("x" * 40_000, "x" * 80_000, head + "Ab9" * 20_000 + " tail of it" * 400, (head + "y" * 5000) * 6):
        encoded.clear()
        assert tokens.resynchronised(BYTE, t, 1000, 100) == len(b.encode(t, add_special_tokens=False).ids)
        assert sum(encoded) <= 5 * len(t), sum(encoded) / len(t)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, i int, h string")


def test_count_tokens_job(spark):
    rng, b = random.Random(5), lib(BYTE)
    texts = [None, "", *ODD, *[random_text(rng, 400) for _ in range(10)], "y" * 3000, " " * 3000]
    rows = [(i, t, "en", 1, "h") for i, t in enumerate(texts)]
    rows += [rows[-3], rows[-3], (None, texts[-3], "en", 1, "h"), (None, None, None, None, None)]
    got = tokens.count_tokens(docs_of(spark, rows), BYTE, chunk=200, overlap=100).collect()
    want = [(d, len((t or "").encode()), len(b.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert tokens.count_tokens(docs_of(spark, []), BYTE).count() == 0


def check_pieces(rows, got, window):
    w = lib(WORD)
    want = sorted((d is None, d or 0, n) for d, n in ((d, len(w.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, *_ in rows))
    total = sum(n for *_, n in want)
    at = sorted((r.sequence_id * window + r.offset, r) for r in got)
    place = 0
    for p, r in at:  # gapless stream
        assert p == place and 0 < r.length and r.offset + r.length <= window
        place += r.length
    assert place == total
    ids = {d: [*w.encode(t or "", add_special_tokens=False).ids, 1] for d, t, *_ in rows}
    for _, r in at:
        x = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(x) == r.length and zlib.crc32(x.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for _, r in at if r.start == 0) == want
    last = max(r.sequence_id for _, r in at)
    left = total - last * window
    for _, r in at:
        full = r.sequence_id < last or left & (left - 1)
        assert r.padded_length == (window if full else left)


def test_packing_round_trip(spark):
    rng = random.Random(9)
    texts = [None, "", *ODD, *[random_text(rng, 300) for _ in range(20)], "word " * 5000]
    rows = [(i, t, "en", 1, "h") for i, t in enumerate(texts)] + [(4, texts[4], "x", 2, "g"), (None, "n", "x", 1, "")]
    got = packing.pack(docs_of(spark, rows).repartition(5), window=64).collect()
    check_pieces(rows, got, 64)
    assert packing.pack(docs_of(spark, [])).count() == 0
    one = packing.pack(docs_of(spark, [(1, None, "x", 1, "")])).collect()
    assert [(r.doc_id, r.length, r.padded_length) for r in one] == [(1, 1, 1)]


def test_op3_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_pieces(rows, packing.op3_packing(spark, sf).collect(), 2048)
