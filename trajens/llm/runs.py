"""Periodic runs of words by online dyadic square catching.

A run is a stretch of consecutive words with smallest period q whose length is at least
``min_length`` and ``min_exponent`` times q, and that no neighbouring word extends keeping period q
(a phrase repeated over and over, a table row pasted a hundred times).

Words are appended one at a time. Every completed aligned block of 2^j words gets a name (equal
blocks, equal names; a block's name is that of its two halves), and the block's catcher then waits
for the suffix: each appended word names the suffixes of 2^j words as far up as they equal a
completed block. When the suffix of 2^(j+1) words equals two neighbouring blocks of 2^j words that
lie q words earlier, 2^j <= q < 2^(j+1), the stretch from the blocks to the suffix is a square of
period q; it is followed to the left once, and from then on one comparison per appended word
keeps it open or closes it as a finished run. A square inside an open run whose period divides q
is that run's own and is passed over, so periods are the smallest. A run of exponent 4 holds
two such blocks and their copies wherever the blocks lie (3 * 2^j - 1 <= 3 q), so none is missed;
lower exponents aren't offered. Work is O(log n) a word, memory O(n log n) 4-byte names at
worst, for the levels that the text's repetition reaches.

A document is one row and is worked on where it is read: no shuffle, no state between rows.

Edge cases: null or empty text has no words and no runs, and null text collapses to null; very long
texts are read whole; ties among a text's strongest runs go to the smaller start, then period;
null ids and repeated rows each keep their row; other columns pass through, and added ones get a
free name when theirs is taken; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajens.llm.common import SPACE, free_name, table

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: rows per Arrow batch that a task works on, so that texts of one batch stay few
_ROWS = 1024


class SquareCatcher:
    """Online run finder over appended words; ``finished`` holds (start, length, period)."""

    def __init__(self, min_length: int = 6, min_exponent: int = 4):
        if min_exponent < 4:
            raise ValueError("blocks are laid out for runs of exponent 4 or more")
        self.min_length, self.min_exponent = min_length, min_exponent
        self.words: list[int] = []
        #: level -> name of the suffix of 2^level words that ends at a place, 0 where it has none
        self.names: list[array] = []
        #: level -> {name of left half, name of right half, as one number: name} of completed aligned blocks
        self.blocks: list[dict[int, int]] = []
        #: period -> start of the stretch that still goes on
        self.open: dict[int, int] = {}
        self.finished: list[tuple[int, int, int]] = []
        self._ids: dict = {}
        self._room = 0

    def _close(self, q: int, end: int) -> None:
        start = self.open.pop(q)
        if end - start >= max(self.min_length, self.min_exponent * q):
            self.finished.append((start, end - start, q))

    def _caught(self, at: int, q: int) -> None:
        """A square of period q begins at or before ``at`` and reaches the last word."""
        for p, start in self.open.items():
            if q % p == 0 and start <= at:
                return
        w = self.words
        while at and w[at - 1] == w[at - 1 + q]:
            at -= 1
        self.open[q] = at

    def _level(self) -> array:
        self.blocks.append({})
        self.names.append(array("i", bytes(4 * self._room)))
        return self.names[-1]

    def _make_room(self, n: int) -> None:
        if n > self._room:
            more = max(n, 2 * self._room) - self._room
            self._room += more
            for level in self.names:
                level.frombytes(bytes(4 * more))

    def append(self, word) -> None:
        self.extend([word])

    def extend(self, words: Sequence) -> None:
        w, names, blocks, opened, ids = self.words, self.names, self.blocks, self.open, self._ids
        self._make_room(len(w) + len(words))
        if not names:
            self._level()
        pairs, pair_names = blocks[0], names[0]
        n, before = len(w), w[-1] if w else 0
        for word in words:
            x = ids.get(word)
            if x is None:
                x = ids[word] = len(ids) + 1
            w.append(x)
            last, left, before = n, before, x
            n += 1
            if opened:
                for q in [q for q in opened if w[last - q] != x]:
                    self._close(q, last)
            if x == left and last > 1 and w[last - 2] == x:
                self._caught(last - 2, 1)
            # name the suffixes of 2, 4, 8 ... words, as far up as they equal a completed block
            key = left << 32 | x
            name = pairs.get(key)
            if name is None:
                if n & 1:  # not the end of an aligned block
                    continue
                name = pairs[key] = len(pairs) + 1
            pair_names[last] = name
            level, size, j = pair_names, 2, 1
            while True:
                # two neighbouring blocks of ``size`` words, size <= q < 2 size before the last 2 size
                s = n - 2 * size
                b = (s - size) & -size
                if b >= 0 and level[b + 2 * size - 1] == name:
                    first = level[s + size - 1]
                    if first and first == level[b + size - 1] and s - b not in opened:
                        self._caught(b, s - b)
                left = level[last - size] if last >= size else 0
                if not left:
                    break
                key, size = left << 32 | name, 2 * size
                if j == len(names):
                    self._level()
                known = blocks[j]
                name = known.get(key)
                if name is None:
                    if n & (size - 1):
                        break
                    name = known[key] = len(known) + 1
                level = names[j]
                level[last] = name
                j += 1

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs of the words so far, by start, then period."""
        n, least = len(self.words), self.min_length
        still = [(s, n - s, q) for q, s in self.open.items() if n - s >= max(least, self.min_exponent * q)]
        return sorted([*self.finished, *still], key=lambda r: (r[0], r[2]))


def find_runs(words: Sequence, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    c = SquareCatcher(min_length, min_exponent)
    c.extend(words)
    return c.runs()


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """``words`` without those that a run holds after its first period."""
    if not runs:
        return words
    drop = bytearray(len(words))
    for start, length, q in runs:
        drop[start + q:start + length] = b"\1" * (length - q)
    return [x for x, d in zip(words, drop) if not d]


_RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """``docs`` with ``n_words`` (long), ``runs`` (array of start, length, period, by start, then
    period) and ``collapsed`` (each run cut to its first period, words joined by one space)."""
    SquareCatcher(min_length, min_exponent)
    at = docs.columns.index(text_col)
    own = [free_name(docs, n) for n in ("n_words", "runs", "collapsed")]
    schema = T.StructType([*docs.schema.fields, T.StructField(own[0], T.LongType()), T.StructField(own[1], _RUN),
                           T.StructField(own[2], T.StringType())])
    runs_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS):
                b = whole.slice(lo, _ROWS)
                n, found, rest = [], [], []
                for text in b.column(at).to_pylist():
                    words = _WORD.findall(text or "")
                    runs = find_runs(words, min_length, min_exponent)
                    n.append(len(words))
                    found.append([{"start": s, "length": k, "period": q} for s, k, q in runs])
                    rest.append(None if text is None else " ".join(collapsed(words, runs)))
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(n, pa.int64()), pa.array(found, runs_type), pa.array(rest, pa.string())],
                    names=schema.names)

    return docs.mapInArrow(run, schema)


def strongest(runs: str) -> Column:
    """The run with the greatest exact length / period; ties: smaller start, then period."""
    def better(a, r):
        x, y = r["length"] * a["period"], a["length"] * r["period"]
        return F.when(a.isNull() | (x > y), r).otherwise(a)  # runs come by start, then period
    none = F.lit(None).cast(_RUN.elementType)
    return F.aggregate(runs, none, better)


def rewritten(id_col: str, text_col: str) -> Column:
    """The contract's input: h = crc32(decimal id); where h % 10 = 0, each word i >= a becomes word
    a + (i - a) % p of the text, a = g % n, p = 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10)."""
    core = F.btrim(text_col, F.lit(SPACE))
    words = F.split(core, r"[\x20\x09-\x0D]+")
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rolled(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    # a one-element array binds the words once
    return F.when((h % 10 == 0) & (core != ""), F.transform(F.array(words), rolled)[0]).otherwise(F.col(text_col))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them rewritten as the contract says: runs of exponent 4 and length
    6 or more, the strongest one, and digests of the runs and of the collapsed text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = periodic_runs(docs.withColumn("text", rewritten("doc_id", "text"))).drop("text")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("best")
    return (found.withColumn("best", strongest("runs"))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
                    best["length"].alias("length"), best["period"].alias("period"),
                    F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                    F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"), "n_words"))
