"""Concatenate and cut: documents' token ids as one stream, cut into fixed windows.

Pass 1 tokenizes each partition where it is read and writes the ids with their running position in
the partition (one job; the table in the shared folder fixes the order for good). Pass 2 adds up
the partition totals into global offsets (one row per partition) and cuts at every multiple of
``window``; a document or partition that straddles a boundary gives one record on either side, so
only the last sequence is short. No row is shuffled in either pass.

Edge cases: null text counts as empty and gives just the end id; an empty table gives no pieces;
null ids and repeated rows keep their own pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajens.llm.common import partition_offsets, store, table
from trajens.llm.tokens import byte_slices, joined_ids, piece_ids

_PASS1 = "pid int, at long, doc_id long, n long, ids binary"
_PASS2 = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def token_stream(docs: DataFrame, name: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(pid, at, doc_id, n, ids): ids as little-endian 16-bit numbers, ``at`` their place in
    partition ``pid``. Word BPE files of the tokenizers library (nothing crosses white space)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, at, words = TaskContext.get().partitionId(), 0, piece_ids(name)
        end = np.array([end_id], "<u2").tobytes()
        for b in batches:
            texts = pc.fill_null(b.column(1).cast(pa.large_binary()), b"")
            for lo, hi in byte_slices(texts):
                ids = joined_ids(words, texts.slice(lo, hi - lo), end)
                n = pc.binary_length(ids).to_numpy() // 2
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), pid, np.int32)), pa.array(starts), b.column(0).slice(lo, hi - lo),
                     pa.array(n), ids.cast(pa.binary())], names=["pid", "at", "doc_id", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, _PASS1)


def cut(start: int, n: int, window: int) -> list[tuple[int, int]]:
    """[from, to) of a document's pieces: its ids hold places start .. start + n of the stream."""
    edges = [0, *range(window - start % window, n, window), n]
    return list(zip(edges[:-1], edges[1:]))


def pack(docs: DataFrame, name: str = "word_bpe_49k.json", end_id: int = 1, window: int = 2048,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and
    padded_length (``window``; a last sequence whose length is a power of two isn't padded)."""
    stream = store(token_stream(docs, name, end_id, id_col, text_col), "token-stream")
    totals = stream.groupBy("pid").agg(F.sum("n").alias("total"))
    # one row per partition of pass 1: (int, long), bounded by the number of tasks, not by the data
    before = F.broadcast(partition_offsets(totals, "pid", "total"))
    placed = stream.join(before, "pid").select("doc_id", (F.col("at") + F.col("_before")).alias("at"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[] for _ in range(7)]
            for doc, at, n, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                for lo, hi in cut(at, n, window):
                    row = (doc, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), n,
                           (at + lo) // window, (at + lo) % window)
                    for c, v in zip(cols, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    names = [c.split()[0] for c in _PASS2.split(", ")]
    pieces = placed.mapInArrow(run, _PASS2)
    whole = F.broadcast(totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("_ids")))  # one row
    left = F.least(F.col("_ids") - F.col("sequence_id") * window, F.lit(window))
    full = F.when(F.expr("bit_count(_left)") == 1, F.col("_left")).otherwise(F.lit(window))
    return (pieces.crossJoin(whole).withColumn("_left", left.cast("long"))
            .select(*names, full.cast("long").alias("padded_length")))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, 49k word BPE, end id 1, sequences of 2048."""
    return pack(table(spark, sf_dir, "documents"))
