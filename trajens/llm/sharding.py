"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Rows fall into blocks by a keyed hash; block sizes are counted.
2. The matrix entry (block, shard) says how many of the block's rows go to the shard. Under a
   uniform random permutation the entries follow the multivariate hypergeometric law with the
   block sizes and shard sizes as margins; they are drawn one conditional hypergeometric at a
   time. Only the counts come to the driver: one long per block, one block per ``block_rows`` rows; the matrix goes
   back as a table, written in slices of ``MATRIX_SLICE`` blocks.
3. Each block is permuted locally (ordered by a keyed hash) and cut by its row of the matrix.
4. Rows are exchanged; each shard is permuted again: sub-blocks by a second keyed hash, ordered
   within, with the counts before a sub-block as offset. A shard never lies in one task.

All steps on rows are DataFrame functions. Hashes are of id and text; of rows whose copies alone would fill
half a block, also of the row's place in the table that is written first, so that they fall into all
blocks. Places are read back, never made twice: a lost task draws the same permutation again. Shard sizes
differ by at most one (law ``rows``).

Edge cases: null text has no bytes (size 1, CRC of nothing); null ids hash as null; rows equal in id
and text are interchangeable; very long texts are read once, for their size and hashes; fewer rows than shards leave the last
shards empty; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import json
import math
import random
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajens.llm.common import partition_offsets, store, table
from trajens.session import checkpoint_dir


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` without replacement, by inversion outward from the
    mode (about one standard deviation of steps)."""
    lo, hi = max(0, draws - bad), min(good, draws)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(_log_choose(good, mode) + _log_choose(bad, draws - mode)
                 - _log_choose(good + bad, draws))
    u = rng.random() - p
    down, up, p_down, p_up = mode, mode, p, p
    while u > 0 and (down > lo or up < hi):
        if up < hi:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > lo:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(block_sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Random matrix with these margins, law of a uniform permutation."""
    rng, left, out = random.Random(seed), list(shard_sizes), []
    for n in block_sizes:
        row, rest = [], sum(left)
        for j, c in enumerate(left):
            rest -= c
            k = hypergeometric(rng, c, rest, n)
            row.append(k)
            n -= k
        left = [c - k for c, k in zip(left, row)]
        out.append(row)
    return out


#: blocks of the matrix that one literal brings into a plan
MATRIX_SLICE = 16_384


def matrix_table(spark: SparkSession, blocks: list[int], matrix: list[list[int]]) -> DataFrame:
    """(b, ends): block and, per shard, how many of its rows go to shards up to that one."""
    schema, path = "b bigint, ends array<bigint>", f"{checkpoint_dir(spark)}/tables/shard-matrix-{uuid.uuid4().hex}"
    for at in range(0, max(1, len(blocks)), MATRIX_SLICE):
        part = [{"b": b, "ends": list(itertools.accumulate(row))}
                for b, row in zip(blocks[at:at + MATRIX_SLICE], matrix[at:at + MATRIX_SLICE])]
        rows = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(part)), "array<struct<b:bigint,ends:array<bigint>>>")))
        rows.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread_copies(rows: DataFrame, blocks: int, sizes: list[tuple[int, int]]) -> DataFrame | None:
    """``rows`` (with ``k1``, ``k2``, ``place``) with other hashes where one pair of them is that of more than half
    a mean block, or None if there is no such pair. Looks into blocks of over 1.5 times the mean alone."""
    mean = sum(n for _, n in sizes) / blocks
    full = [b for b, n in sizes if n > 1.5 * mean]
    if not full:
        return None
    hot = (rows.where(F.pmod("k1", F.lit(blocks)).isin(full)).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
           .where(F.col("n") > max(1.0, mean / 2)).select(F.col("k1").alias("h1"), F.col("k2").alias("h2")))
    hot = store(hot, "shard-hot")
    if hot.isEmpty():
        return None
    # fewer than two pairs per block can have more than half a block's rows
    met = rows.join(F.broadcast(hot), (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
    apart = lambda k: F.when(F.col("h1").isNotNull(), F.xxhash64(k, "place")).otherwise(F.col(k)).alias(k)
    return met.select("doc_id", "size", "text_crc32", apart("k1"), apart("k2"), "place")


def shuffle_to_shards(docs: DataFrame, n_shards: int = 8, seed: int = 17, block_rows: int = 262_144,
                      least_blocks: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row per input row."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    key = lambda s: F.xxhash64(F.lit(seed), F.lit(s), F.col(id_col), F.col(text_col))
    rows = store(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                             (F.octet_length(raw) + 1).cast("long").alias("size"),
                             F.crc32(raw).alias("text_crc32"), key("block").alias("k1"),
                             key("slot").alias("k2"), F.monotonically_increasing_id().alias("place")), "shard-rows")
    blocks = max(least_blocks, math.ceil(rows.count() / block_rows))
    counted = lambda d: sorted((r[0], r[1]) for r in d.groupBy(F.pmod("k1", F.lit(blocks))).count().collect())
    sizes = counted(rows)
    spread = spread_copies(rows, blocks, sizes)
    if spread is not None:
        rows, sizes = spread, counted(spread)
    rows = rows.withColumn("block", F.pmod("k1", F.lit(blocks)))
    total = sum(n for _, n in sizes)
    shards = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([n for _, n in sizes], shards, seed)
    plan = matrix_table(spark, [b for b, _ in sizes], matrix)
    nth = F.row_number().over(Window.partitionBy("block").orderBy("k1", "k2", "doc_id", "text_crc32"))
    # rows are dealt out by block already: where the matrix is too large to broadcast, only it moves
    sent = (rows.withColumn("nth", nth).join(plan, F.col("block") == F.col("b"))
            .select("doc_id", "size", "text_crc32", "k2",
                    F.size(F.filter("ends", lambda e: e < F.col("nth"))).alias("shard")))
    sent = store(sent.withColumn("sub", F.pmod("k2", F.lit(blocks))), "shard-sent")
    chunk = F.col("shard").cast("long") * blocks + F.col("sub")
    counts = sent.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = partition_offsets(counts.select(chunk.alias("chunk"), "n"), "chunk", "n")
    starts = F.array(*[F.lit(sum(shards[:j])).cast("long") for j in range(n_shards)])
    local = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("k2", "doc_id", "text_crc32", "size"))
    return (sent.withColumn("local", local).withColumn("chunk", chunk)
            # one row per sub-block, n_shards sub-blocks per block
            .join(F.broadcast(before), "chunk")
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("_before") - F.element_at(starts, F.col("shard") + 1) + F.col("local") - 1)
                    .cast("long").alias("slot")))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 under the law ``rows`` (counts at most one apart)."""
    s = shuffle_to_shards(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))
