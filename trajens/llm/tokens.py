"""Token counts and ids of whole texts with the library of a public tokenizer file.

Common path: a text is cut only where the tokenizer itself always cuts, each distinct piece is
encoded once by the library and remembered in a bounded table of the Python worker.

* byte-level BPE (``text_counts``): its pattern never joins a character that isn't white space to
  white space after it, so there is a cut before every space that follows such a character. Texts
  with a space after other white space take the slower exact cut.
* word BPE with word ends (``joined_ids``): white space is dropped and nothing crosses it, so a whole
  batch is cut at ASCII white space, folded and numbered as arrays; Python sees distinct pieces only.

Special strings hold no white space, so no cut falls inside one.

Huge texts (``count_tokens``): texts longer than ``chunk`` characters become overlapping chunks,
dealt to many tasks and encoded with offsets; see ``resynchronised``.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajens.llm.common import SPACE, slices, store, table

_ODD = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


@lru_cache(maxsize=8)
def tokenizer(path: str):
    """The library's tokenizer, one thread (Spark's tasks are the parallelism)."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceTable:
    """piece -> value of its encoding, in two generations of at most ``room`` / 2 pieces each: when
    the young one is full it becomes the old one, and the old one's unused pieces go.

    A comma or full stop after a letter or digit always is a token piece of its own, so it is split
    off before a new piece is encoded. Values add up (counts)."""

    def __init__(self, name: str, value, room: int = 800_000, longest: int = 64):
        self.name, self.value, self.room, self.longest = name, value, room, longest
        self.young, self.old = {}, {}

    def _parts(self, p) -> tuple:
        tail = p[-1:]
        core = p
        if len(p) > 2 and tail in (",", ".") and p[-2:-1].isalnum():
            core = p[:-1]
        else:
            tail = None
        return core, tail

    def look_up(self, pieces: list) -> list:
        got = list(map(self.young.get, pieces))
        if None not in got:
            return got
        old, fresh, parts = self.old, {}, {}
        for p in {p for p, g in zip(pieces, got) if g is None}:
            v = old.get(p)
            if v is None:
                parts[p] = self._parts(p)
            else:
                fresh[p] = v
        need = {x for pair in parts.values() for x in pair if x is not None}
        known = {x: v for x in need if (v := self.young.get(x, old.get(x))) is not None}
        new = [x for x in need if x not in known]
        if new:
            lib = tokenizer(tokenizer_path(self.name))
            known.update((x, self.value(e.ids)) for x, e in zip(new, lib.encode_batch_fast(new, add_special_tokens=False)))
        for p, (core, tail) in parts.items():
            fresh[p] = known[core] if tail is None else known[core] + known[tail]
        fresh.update((x, known[x]) for x in new)
        got = [fresh[p] if g is None else g for p, g in zip(pieces, got)]
        half = self.room // 2
        for x, v in fresh.items():
            if len(x) <= self.longest:
                if len(self.young) >= half:
                    self.young, self.old = {}, self.young
                self.young[x] = v
        return got


def sub_batches(texts: list, most: int = 1 << 23) -> Iterator[list]:
    """``texts`` in order, about ``most`` bytes or characters at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _coded(split: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
    """(offsets of the texts, number of each piece, distinct pieces) of a split column."""
    words = split.flatten().dictionary_encode()
    return (split.offsets.to_numpy() - split.offsets[0].as_py(), words.indices.to_numpy(zero_copy_only=False),
            words.dictionary.to_pylist())


def text_counts(table: PieceTable, texts: list[str | None]) -> list[int]:
    """Tokens of each text, byte-level BPE."""
    out = []
    for part in sub_batches([t or "" for t in texts]):
        n = np.zeros(len(part), np.int64)
        odd = np.array([_ODD.search(t) is not None for t in part], bool)
        for i in np.flatnonzero(odd):
            n[i] = sum(table.look_up(_CUT.split(part[i])))
        plain = np.flatnonzero(~odd)
        if len(plain):
            split = pc.split_pattern(pa.array([part[i] for i in plain], pa.large_string()), " ")
            offsets, number, distinct = _coded(split)
            each = np.array(table.look_up([f" {w}" for w in distinct]), np.int64)[number]
            # the first piece of a text has no space before it
            first = offsets[:-1]
            each[first] = table.look_up([distinct[k] for k in number[first]])
            total = np.concatenate([[0], np.cumsum(each)])
            n[plain] = total[offsets[1:]] - total[first]
        out += n.tolist()
    return out


#: kinds of bytes; closing marks stand in no special string
_BLANK, _UPPER, _LETTER, _WORDY, _MARK = 1, 2, 4, 8, 16
_CHARS = {_BLANK: SPACE, _UPPER: string.ascii_uppercase, _LETTER: string.ascii_letters,
          _WORDY: string.ascii_letters + string.digits, _MARK: '!"#$%&)*,.:;?'}
_KIND = bytes(sum(k for k, chars in _CHARS.items() if chr(i) in chars) for i in range(256))
_EMPTY = pa.array([], pa.large_binary())


def _binary(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """Consecutive stretches of ``data``, ``sizes`` bytes long."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _ends(column: pa.Array) -> np.ndarray:
    """Offsets of a large binary column in its data buffer, one more than it has rows."""
    return np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset:]


def word_pieces(column: pa.Array, fold: bool) -> tuple[np.ndarray, pa.Array]:
    """(number of the first piece of each text, and of all; pieces) of UTF-8 texts (no nulls).

    Pieces are what lies between ASCII white space. Closing marks at their end, after an ASCII letter or
    digit, always are a token piece of their own and split off. With ``fold`` (files that lower-case)
    pieces of nothing but ASCII letters are lower-cased."""
    at = _ends(column)
    at, lo = at - at[0], int(at[0])
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[lo:lo + at[-1]] if at[-1] else np.empty(0, np.uint8)
    kind = np.frombuffer(data.tobytes().translate(_KIND), np.uint8)
    begins = np.zeros(len(data) + 1, bool)  # places where a text begins (or all end)
    begins[at] = True
    keep = (kind & _BLANK) == 0
    over = begins.copy()  # nothing reaches this place from the left
    over[:-1] |= ~keep
    first = keep & begins[:-1]
    first[1:] |= keep[1:] & ~keep[:-1]
    mark = (kind & _MARK) != 0
    from_, to = mark.copy(), mark.copy()  # first and last byte of each run of marks
    from_[1:] &= ~mark[:-1] | begins[1:-1]
    to[:-1] &= ~mark[1:] | begins[1:-1]
    from_, to = np.flatnonzero(from_), np.flatnonzero(to)
    first[from_[over[to + 1] & ~first[from_] & ((kind[from_ - 1] & _WORDY) != 0)]] = True
    numbers = np.searchsorted(np.flatnonzero(first), at)
    data, kind, start = data[keep], kind[keep], np.flatnonzero(first[keep])
    if fold and len(start):
        upper = np.flatnonzero(kind & _UPPER)
        letters = np.bitwise_and.reduceat(kind, start) & _LETTER != 0
        data[upper[letters[np.searchsorted(start, upper, "right") - 1]]] += 32
    return numbers, _binary(np.diff(start, append=len(data)), data)


class IdTable:
    """piece -> its ids as little-endian 16-bit numbers, in two generations like ``PieceTable``; a
    dictionary gives a piece's place in an array of ids, so texts are put together by array steps."""

    def __init__(self, name: str, room: int = 800_000, longest: int = 64, joined: int = 32):
        self.name, self.room, self.longest, self.joined = name, room, longest, joined
        self.young, self.young_ids, self.old, self.old_ids = {}, _EMPTY, {}, _EMPTY
        self.closing = None

    def look_up(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(ids, place of each of the distinct ``pieces`` there)"""
        names = pieces.to_pylist()
        place = np.array(list(map(self.young.get, names, repeat(-1))), np.int64)
        miss = np.flatnonzero(place < 0)
        if not len(miss):
            return self.young_ids, place
        was = np.array([self.old.get(names[i], -1) for i in miss.tolist()], np.int64)
        # in this order: old ones, new ones, and last those too long to remember
        new = miss[was < 0]
        short = np.diff(_ends(pieces))[new] <= self.longest
        new = np.concatenate([new[short], new[~short]])
        fresh = [names[i] for i in (*miss[was >= 0].tolist(), *new.tolist())]
        values = pa.concat_arrays([self.old_ids.take(pa.array(was[was >= 0])), self.encoded(fresh[len(fresh) - len(new):])])
        place[np.concatenate([miss[was >= 0], new])] = len(self.young_ids) + np.arange(len(fresh))
        ids = pa.concat_arrays([self.young_ids, values])
        half = self.room // 2
        n = min(half, len(fresh) - int((~short).sum()))
        if len(self.young) + n > half:
            self.old, self.old_ids, self.young, self.young_ids = self.young, self.young_ids, {}, _EMPTY
        self.young.update(zip(fresh[:n], range(len(self.young), len(self.young) + n)))
        self.young_ids = pa.concat_arrays([self.young_ids, values.slice(0, n)])
        return ids, place

    def encoded(self, pieces: list[bytes]) -> pa.Array:
        """Ids of each piece by the library."""
        lib, texts = tokenizer(tokenizer_path(self.name)), [p.decode() for p in pieces]
        encode = partial(lib.encode_batch_fast, add_special_tokens=False)
        done, parts = self.encoded_words(encode, texts) if self.closes(lib) is not None else (np.empty(0, np.int64), [])
        alone = np.setdiff1d(np.arange(len(texts)), done)
        parts.append(pa.array([_packed(e.ids) for e in encode([texts[i] for i in alone])], pa.large_binary()))
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate([done, alone]))))

    def encoded_words(self, encode, texts: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
        """(numbers of the texts done, their ids). Pieces of letters are one word each wherever they stand,
        so ``joined`` of them are encoded as one text and told apart by the ids that close a word. Each
        piece closes a word (a byte-level file leaves no letter out), so where ends are as many as
        pieces, each piece has one; a group where they aren't is encoded piece by piece."""
        words = np.array([i for i, t in enumerate(texts) if t.isalpha()], np.int64)
        if not len(words):
            return words, []
        groups = np.split(words, range(self.joined, len(words), self.joined))
        lists = [e.ids for e in encode([" ".join([texts[i] for i in g]) for g in groups])]
        held, size = np.array([len(g) for g in groups]), np.array([len(x) for x in lists])
        ids = np.frombuffer(_packed([i for x in lists for i in x]), "<u2")
        closing = self.closing[ids]
        before, edges = (np.concatenate([[0], np.cumsum(x)]) for x in (closing, size))
        good = (np.diff(before[edges]) == held) & np.append(closing, False)[edges[1:] - 1]
        ids, closing = ids[np.repeat(good, size)], closing[np.repeat(good, size)]
        return words[np.repeat(good, held)], [_binary(2 * np.diff(np.flatnonzero(closing), prepend=-1), ids)]

    def closes(self, lib) -> np.ndarray | None:
        """Whether an id closes a word, by id; None if the file marks no word ends."""
        suffix = getattr(lib.model, "end_of_word_suffix", None)
        if self.closing is None and suffix:
            vocab = lib.get_vocab(with_added_tokens=False)
            closing = np.zeros(1 << 16, bool)
            closing[[i for t, i in vocab.items() if t.endswith(suffix) and i < len(closing)]] = True
            self.closing = closing
        return self.closing


def byte_slices(column: pa.Array, most: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Bounds [from, to) of stretches of a large binary column, about ``most`` bytes each."""
    group = (_ends(column)[:-1] - _ends(column)[0]) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
    return ((lo, hi) for lo, hi in zip(edges, edges[1:]) if lo < hi)


def joined_ids(table: IdTable, column: pa.Array, end: bytes) -> pa.Array:
    """Ids of each text of a large binary column without nulls, word BPE, with ``end`` appended."""
    numbers, pieces = word_pieces(column, fold=True)
    coded = pieces.dictionary_encode()
    ids, place = table.look_up(coded.dictionary)
    each = np.insert(place[coded.indices.to_numpy(zero_copy_only=False)], numbers[1:], len(ids))
    flat = pa.concat_arrays([ids, pa.array([end], pa.large_binary())]).take(pa.array(each))
    # a text's ids begin where its first piece's do; each text before it added one piece
    offsets = _ends(flat)[numbers + np.arange(len(numbers))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(offsets), flat.buffers()[2]])


def text_ids(table: IdTable, texts: list[bytes | None], end: bytes) -> list[bytes]:
    """``joined_ids`` of a list; null counts as empty."""
    column = pa.array([t or b"" for t in texts], pa.large_binary())
    return [x for lo, hi in byte_slices(column) for x in joined_ids(table, column.slice(lo, hi - lo), end).to_pylist()]


@lru_cache(maxsize=4)
def piece_counts(name: str) -> PieceTable:
    """Table of a Python worker, kept between its tasks."""
    return PieceTable(name, len)


@lru_cache(maxsize=4)
def piece_ids(name: str) -> IdTable:
    """Table of a Python worker, for byte-level word BPE files that lower-case."""
    return IdTable(name)


def _packed(ids: list) -> bytes:
    return np.array(ids, "<u2").tobytes() if max(ids, default=0) < 65536 else _wide(ids)


def _wide(ids):
    raise ValueError(f"token id {max(ids)} does not fit 16 bits")


# --- huge texts ------------------------------------------------------------------------------

def chunk_bounds(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Bounds [start, end) of chunks; each begins ``overlap`` characters before the last one's end."""
    out, end = [], 0
    while end < length:
        start = max(0, end - overlap)
        end = min(length, (start if not out else end) + chunk)
        out.append((start, end))
    return out


def piece_starts(name: str, text: str, at: int, stop: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Encode ``text`` (whose first character has place ``at`` in its document) with offsets.

    Returns (places, tokens_before, n): where the pre-tokenizer began a piece, and how many tokens
    of the chunk stand before each; ``stop`` adds the end of the text as a last place."""
    e = tokenizer(tokenizer_path(name)).encode(text, add_special_tokens=False)
    words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    starts = np.array([o[0] for o in e.offsets], np.int64)
    fresh = np.ones(len(words), bool)
    if len(words):
        # a special string has no word number and stands alone
        fresh[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
    idx = np.flatnonzero(fresh)
    places, before = starts[idx] + at, idx
    if stop:
        places, before = np.append(places, at + len(text)), np.append(before, len(words))
    return places, before, len(words)


def splice(left: tuple, right: tuple, left_end: int, margin: int) -> tuple[int, int, int] | None:
    """First place where both chunks begin a piece, proven stable: (place, tokens of the left
    chunk before it, tokens of the right chunk before it), or None.

    Pre-tokenization is memoryless: what follows a piece's start depends only on the text from
    there on. The left chunk is right up to any piece start that is followed by another one and
    lies ``margin`` characters (more than the longest special string) before the chunk's end, and
    from a place where both begin a piece the right chunk continues exactly as the left would."""
    lp, lb = left
    rp, rb = right
    ok = lp <= left_end - margin
    if len(lp):
        ok[-1] = False
    common, li, ri = np.intersect1d(lp[ok], rp, return_indices=True)
    if not len(common):
        return None
    return int(common[0]), int(lb[ok][li[0]]), int(rb[ri[0]])


def resynchronised(name: str, text: str, chunk: int, overlap: int, margin: int = 64) -> int:
    """Tokens of one text by overlapping chunks in one task; the plain form of the Spark job
    below, used by its last step and by tests.

    Where two chunks share no piece start, the overlap is widened to the last proven one (a piece
    start of the left chunk that is stable, or where it was itself spliced): there they align by
    construction. A chunk is never shorter than the way since the last proven start, so a run without
    any boundary is encoded in doubling widths, about three times over in all, not once per chunk."""
    # the left chunk: piece starts, its end, the last proven start and the chunk's tokens before that
    total, left, left_end, proven, used = 0, None, 0, 0, 0
    while left is None or left_end < len(text):
        end = min(len(text), left_end + max(chunk, left_end - proven))
        s = max(proven, left_end - overlap) if left else 0
        right = piece_starts(name, text[s:end], s, False)
        cut = (0, 0, 0)
        if left:
            # places up to margin behind the right chunk's start may lie in a cut special string
            far = (right[0] >= s + margin) & (right[0] > proven)
            cut = splice(left[:2], (right[0][far], right[1][far]), left_end, margin)
            if cut is None:
                stable = np.flatnonzero((left[0] <= left_end - margin) & (left[0] > proven))
                stable = stable[stable < len(left[0]) - 1]
                at = (int(left[0][stable[-1]]), int(left[1][stable[-1]])) if len(stable) else (proven, used)
                if at[0] != s:
                    right = piece_starts(name, text[at[0]:end], at[0], False)
                cut = (*at, 0)
            total += cut[1] - used
        left, left_end, proven, used = right, end, cut[0], cut[2]
    return total + left[2] - used


def count_tokens(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = 32768, overlap: int = 512, margin: int = 64) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row per input row, whole texts.

    ``name``: a byte-level BPE file of the tokenizers library. Texts up to ``chunk`` characters are
    counted where they are read. Longer ones are cut into chunks of ``chunk`` characters that begin
    ``overlap`` characters early, dealt over the tasks, encoded with offsets, and spliced pairwise
    at the first proven common piece start. Where two chunks share none, their document is counted
    with overlaps widened to the last proven start (``resynchronised``): time near linear in the text,
    memory that of its longest stretch without a boundary.

    Null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows keep their rows;
    other columns are not read; an empty table gives an empty result."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk)
    long_ = rows.where(F.length("text") > chunk)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(name)
        for b in batches:
            n = text_counts(counts, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    out = "doc_id long, n_bytes long, n_tokens long"
    done = short.select("doc_id", size.alias("n_bytes"), "text").mapInArrow(small, out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each text is read once, and its chunks leave a few at a time
        for b in slices(batches, 16):
            for doc, n_bytes, h, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                bounds = chunk_bounds(len(text), chunk, overlap)
                for at in range(0, len(bounds), 64):
                    few = bounds[at:at + 64]
                    columns = ([doc] * len(few), [n_bytes] * len(few), [h] * len(few), [len(bounds) - 1] * len(few),
                               range(at, at + len(few)), [s for s, _ in few], [text[s:e] for s, e in few])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, cut_types)], names=cut_names)

    cut_names = ["doc_id", "n_bytes", "h", "last", "i", "s", "part"]
    cut_types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
    chunks = (long_.select("doc_id", size.alias("n_bytes"), F.xxhash64("text").alias("h"), "text")
              .mapInArrow(cut, "doc_id long, n_bytes long, h long, last int, i int, s long, part string")
              .repartition("h", "doc_id", "i"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                p, before, n = piece_starts(name, r["part"], r["s"], False)
                end = r["s"] + len(r["part"])
                head = (p >= r["s"] + margin) & (p <= r["s"] + overlap)
                tail = np.flatnonzero((p >= end - overlap) & (p <= end - margin) & (np.arange(len(p)) < len(p) - 1))
                rows.append({k: r[k] for k in ("doc_id", "n_bytes", "h", "last", "i")}
                            | {"n": n, "head": p[head].tolist(), "head_n": before[head].tolist(),
                               "tail": p[tail].tolist(), "tail_n": before[tail].tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("h", pa.int64()),
                        ("last", pa.int32()), ("i", pa.int32()), ("n", pa.int64()),
                        *[(c, pa.list_(pa.int64())) for c in ("head", "head_n", "tail", "tail_n")]])
    ends = chunks.mapInArrow(encode, "doc_id long, n_bytes long, h long, last int, i int, n long, "
                             "head array<long>, head_n array<long>, tail array<long>, tail_n array<long>")
    # repeated rows (same id, same text) have equal chunks: one of each is enough here
    ends = store(ends.dropDuplicates(["doc_id", "h", "i"]), "token-chunks")
    nxt = ends.select("doc_id", "h", (F.col("i") - 1).alias("i"), "head", "head_n")
    met = (ends.alias("l").join(nxt.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
                                & (F.col("l.h") == F.col("r.h")) & (F.col("l.i") == F.col("r.i")), "left")
           .select("l.doc_id", "l.n_bytes", "l.h", "l.last", "l.i", "l.n", "l.tail", "l.tail_n",
                   "r.head", "r.head_n",
                   F.array_min(F.array_intersect("l.tail", "r.head")).alias("place")))
    at = lambda n, places: F.element_at(n, F.array_position(places, F.col("place")).cast("int"))
    parts = met.select("doc_id", "h", "n_bytes",
                       F.when(F.col("i") == F.col("last"), F.col("n"))
                       .otherwise(at(F.col("tail_n"), F.col("tail"))
                                  - at(F.col("head_n"), F.col("head"))).alias("part"),
                       ((F.col("i") < F.col("last")) & F.col("place").isNull()).alias("apart"))
    # a chunk counts up to its splice; what the next one counts before the splice is taken off
    spliced = parts.groupBy("doc_id", "h", "n_bytes").agg(
        F.sum("part").alias("n_tokens"), F.max("apart").alias("apart"))
    spliced = store(spliced, "token-splices")

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [resynchronised(name, t, chunk, 2 * overlap, margin) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    # one output row per input row again
    keyed = long_.select("doc_id", F.xxhash64("text").alias("h"), "text")
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))
    aligned = (keyed.select("doc_id", "h").alias("d").join(spliced.where("not apart").alias("s"), same("d", "s"))
               .select("d.doc_id", "s.n_bytes", "s.n_tokens"))
    rest = (keyed.alias("d").join(spliced.where("apart").alias("s"), same("d", "s"))
            .select("d.doc_id", "s.n_bytes", "d.text").mapInArrow(widen, out))
    return done.unionByName(aligned).unionByName(rest)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document with the 50k byte-level BPE; over_limit beyond 512 tokens."""
    n = count_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
    return n.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
