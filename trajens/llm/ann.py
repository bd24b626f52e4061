"""Nearest neighbours by largest inner product over shifted space-filling curves.

Curves. Vectors are brought onto the unit sphere the usual way for inner products (divided by the
largest norm, one coordinate added to fill up; queries get 0 there), projected on a few random
orthonormal directions, shifted at random, cut to a grid and ordered along the Hilbert curve. Each
of ``curves`` orderings is range-partitioned in Spark and cut into blocks of ``block`` vectors. A
query is compared with its own block and the next on either side; the windows of all curves merge,
and scores are inner products of the original vectors in double precision.

The rest. Neighbours spread over many directions don't stay together on any curve. How many a query
has missed is estimated from how often its neighbours were found (Chao's estimate from those seen
on one curve only and on two). Copies of one vector share a key and are found together, so what
counts is different vectors. Where the estimate is over ``missed`` of those found, or they are less
than half of k, or fewer than k rows were found, the stated query is compared with every block of one ordering; only vectors that reach the
k-th score it already has come back, the k best of a task at most. These scans are exact. Queries and
blocks meet in tiles, one to a task, which holds the tile's queries and takes its blocks one by one;
no join is made, so that none can be planned as a broadcast through the driver, whatever the tables'
sizes on disk (compressed, and not counting the copies of a query for each tile) suggest.

Copies. Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest, so further
copies (cut by a per-group limit before any exchange) are no candidates; they still are queries.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite component take no part,
nor does a null id, nor a vector whose length is not the most common one (smallest on a tie);
of several vectors with one id the least counts; ties go to the smaller id; with fewer than k others
all are returned; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajens.llm.common import partition_offsets, slices, store, table


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``grid`` (n x dims, integers below 2^bits), after
    Skilling, "Programming the Hilbert curve" (2004): undo the excess rotations from the top bit
    down, Gray-encode, then interleave the bits."""
    x = grid.T.astype(np.int64).copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip, q = np.zeros(x.shape[1], np.int64), top
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    key = np.zeros(x.shape[1], np.int64)
    for b in reversed(range(bits)):
        for i in range(dims):
            key = (key << 1) | (((x[i] ^ flip) >> b) & 1)
    return key


class Curve:
    """One random projection, shift and grid."""

    def __init__(self, seed: int, dim: int, directions: int, bits: int):
        rng = np.random.default_rng(seed)
        d = min(directions, dim)
        self.axes = np.linalg.qr(rng.normal(size=(dim, d)))[0]
        self.bits = min(bits, 62 // d)
        self.reach = 4.0 / np.sqrt(dim)  # most projections of unit vectors lie within
        self.shift = rng.uniform(0, 1, d)

    def keys(self, v: np.ndarray) -> np.ndarray:
        cells = 1 << self.bits
        # the shift moves the grid by up to a fifth of its span
        at = ((v @ self.axes) / self.reach + 1 + 0.4 * self.shift) / 2.4
        return hilbert_keys(np.clip((at * cells).astype(np.int64), 0, cells - 1), self.bits)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one query with rows of x, summed in one fixed order."""
    return (x * q).sum(axis=1)


def best_of(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int,
            floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in q, places in x, scores) of each query's k best rows (ties kept), own id left out;
    where ``floor`` is finite, of all rows that reach it instead. No id comes twice in ``ids``."""
    rough = q @ x.T
    by_id = np.argsort(ids)
    own = by_id[np.minimum(np.searchsorted(ids, qid, sorter=by_id), len(ids) - 1)]
    itself = np.flatnonzero(ids[own] == qid)
    rough[itself, own[itself]] = -np.inf
    finite = np.isfinite(rough)
    slack = 1e-9 * (1 + np.abs(rough, where=finite, out=np.zeros_like(rough)).max(initial=0))
    floor = np.full(len(qid), -np.inf) if floor is None else floor.copy()
    bare = np.flatnonzero(~np.isfinite(floor))
    if len(bare):
        m = min(k, len(ids))
        floor[bare] = np.partition(rough[bare], len(ids) - m, axis=1)[:, len(ids) - m]
    i, j = np.nonzero((rough >= (floor - slack)[:, None]) & finite)
    score, step = np.empty(len(i)), max(1, (1 << 21) // x.shape[1])
    for at in range(0, len(i), step):
        some = slice(at, at + step)
        score[some] = exact_scores(q[i[some]], x[j[some]])
    return i, j, score


class Best:
    """The k best rows of each query among those added; ties go to the smaller id. ``floor``: scores
    that a row has to reach, raised as rows come."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor, k
        self.rows = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        self.held = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.rows.append((query, ids, score))
        self.held += len(query)
        if self.held > 2 * self.k * len(self.floor):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the rows that stay."""
        query, ids, score = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        last = nth == self.k - 1
        self.floor[query[last]] = np.fmax(self.floor[query[last]], score[last])
        self.rows = [(query[nth < self.k], ids[nth < self.k], score[nth < self.k])]
        self.held = len(self.rows[0][0])
        return self.rows[0]


def scan_grid(asked: int, vectors: int, blocks: int, parts: int, dim: int,
              tile_pairs: int = 1 << 30, tile_bytes: int = 1 << 24) -> tuple[int, int]:
    """(rows, columns) of tiles for ``asked`` queries against ``vectors`` in ``blocks``: at least one
    tile to a partition, at most ``tile_pairs`` comparisons a tile, queries of about ``tile_bytes`` as
    doubles; of such grids one that makes few copies of both (queries times columns, vectors times rows)."""
    tiles = max(parts, -(-asked * vectors // tile_pairs))
    tall = max(1, round((tiles * asked / vectors) ** 0.5), -(-tiles // blocks), -(-8 * dim * asked // tile_bytes))
    tall = min(asked, tall)
    return tall, min(blocks, -(-tiles // tall))


def vector_hash(x: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of doubles."""
    h = np.full(len(x), 0x9E3779B97F4A7C15, np.uint64)
    for column in np.ascontiguousarray(x + 0.0).view(np.uint64).T:
        h = (h ^ column) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _vectors(raw, dtype: str, dim: int) -> np.ndarray:
    return np.frombuffer(raw if isinstance(raw, bytes) else b"".join(raw), dtype).reshape(-1, dim).astype(np.float64)


def prepared(vectors: DataFrame, is_query: Column, id_col: str, vec_col: str) -> tuple[DataFrame, int, str]:
    """((id, v, norm, is_query), length, dtype): v as little-endian bytes; valid vectors only."""
    kind = vectors.schema[vec_col].dataType.elementType
    dtype = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    v = F.col(vec_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), is_query.alias("is_query"), v.alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return rows, 0, dtype
    rows = (rows.where(F.size("v") == size.d).groupBy("id")
            .agg(F.min("v").alias("v"), F.max(F.coalesce("is_query", F.lit(False))).alias("is_query"))
            .select("id", "is_query", F.transform("v", lambda x: x.cast("double")).alias("v")))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size.d)
            # -0.0 is 0.0, so that equal vectors are equal bytes
            raw = [r.tobytes() for r in (x + 0.0).astype(dtype)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(raw, pa.binary()), pa.array(np.sqrt((x * x).sum(axis=1)))],
                names=["id", "is_query", "v", "norm"])

    return store(rows.mapInArrow(encode, "id long, is_query boolean, v binary, norm double"), "ann-vectors"), size.d, dtype


def _ordered_blocks(rows: DataFrame, curves: list[Curve], dim: int, dtype: str, most: float, block: int) -> DataFrame:
    """(curve, no, ids, vecs, qids, qvecs): blocks of each ordering, numbered along the curve."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _vectors(b.column(2).to_pylist(), dtype, dim)
            norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
            ask = np.array(b.column(1).to_pylist(), bool)[:, None]
            fill = np.where(ask, 0, np.sqrt(np.maximum(0, 1 - (norm / most) ** 2)))
            unit = np.hstack([x / np.where(ask, norm, most), fill])
            for c, curve in enumerate(curves):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), c, np.int32)), pa.array(curve.keys(unit)), b.column(0), b.column(1), b.column(2)],
                    names=["curve", "key", "id", "ask", "v"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seq, now = TaskContext.get().partitionId(), 0, None
        ids, vecs, qids, qvecs = [], [], [], []

        def emit():
            nonlocal ids, vecs, qids, qvecs, seq
            row = {"curve": now, "pid": pid, "seq": seq, "ids": np.array(ids, "<i8").tobytes(), "vecs": b"".join(vecs),
                   "qids": np.array(qids, "<i8").tobytes(), "qvecs": b"".join(qvecs)}
            seq += 1
            ids, vecs, qids, qvecs = [], [], [], []
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for b in batches:
            for c, i, ask, v in zip(*(b.column(n).to_pylist() for n in range(4))):
                if now is not None and (c != now or len(ids) >= block or len(qids) >= block):
                    yield emit()
                now = c
                (qids if ask else ids).append(i)
                (qvecs if ask else vecs).append(v)
        if ids or qids:
            yield emit()

    schema = pa.schema([("curve", pa.int32()), ("pid", pa.int32()), ("seq", pa.int64()),
                        *[(c, pa.binary()) for c in ("ids", "vecs", "qids", "qvecs")]])
    placed = rows.mapInArrow(place, "curve int, key long, id long, ask boolean, v binary")
    ordered = (placed.repartitionByRange("curve", "key", "ask", "id").sortWithinPartitions("curve", "key", "ask", "id")
               .select("curve", "id", "ask", "v"))
    blocks = store(ordered.mapInArrow(cut, "curve int, pid int, seq long, ids binary, vecs binary, qids binary, qvecs binary"),
                   "ann-blocks")
    before = partition_offsets(blocks.groupBy("pid").agg(F.count(F.lit(1)).alias("n")), "pid", "n")
    # one row per range partition. Numbers run over all curves; a neighbour on another curve is no match
    return blocks.join(F.broadcast(before), "pid").withColumn("no", F.col("_before") + F.col("seq"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, curves: int = 8, directions: int = 8, bits: int = 7,
            block: int = 512, missed: float = 0.02, seed: int = 5, scan_groups: int = 1024,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, scanned): k nearest of each row where ``is_query`` holds."""
    spark = vectors.sparkSession
    out = "query_id long, vec_id long, score double"
    rows, dim, dtype = prepared(vectors, is_query, id_col, vec_col)
    most = rows.agg(F.max("norm")).first()[0] if dim else None
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, scanned boolean")
    copies = Window.partitionBy("v").orderBy("id")
    candidates = rows.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1)
    both = candidates.select("id", F.lit(False).alias("ask"), "v").unionByName(
        rows.where("is_query").select("id", F.lit(True).alias("ask"), "v"))
    blocks = _ordered_blocks(both, [Curve(seed + c, dim + 1, directions, bits) for c in range(curves)], dim, dtype, most, block)
    asked = (blocks.where(F.length("qids") > 0)
             .select("curve", "qids", "qvecs", F.explode(F.array(F.col("no") - 1, F.col("no"), F.col("no") + 1)).alias("no")))
    offered = blocks.where(F.length("ids") > 0).select("curve", "no", "ids", "vecs")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            for r in b.to_pylist():
                qid, ids = np.frombuffer(r["qids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                q, x = _vectors(r["qvecs"], dtype, dim), _vectors(r["vecs"], dtype, dim)
                i, j, s = best_of(q, qid, x, ids, k)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(ids[j]), pa.array(s), pa.array(np.full(len(i), r["curve"], np.int32)), pa.array(vector_hash(x)[j])],
                                                     names=["query_id", "vec_id", "score", "curve", "same"])

    # merge: files of many copies are small, what they hold is not, and a planner that goes by files would broadcast it
    seen = asked.join(offered.hint("merge"), ["curve", "no"]).select("curve", "qids", "qvecs", "ids", "vecs").mapInArrow(
        rerank, out + ", curve int, same long")
    # as bits, the curves on which a row was found; copies add up to those of their vector
    merged = seen.groupBy("query_id", "vec_id").agg(
        F.max("score").alias("score"), F.max("same").alias("same"), F.bit_or(F.expr("shiftleft(1L, curve)")).alias("on"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = store(merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ann-found")
    once, twice = F.sum((F.col("hits") == 1).cast("int")), F.sum((F.col("hits") == 2).cast("int"))
    unseen = F.when(twice > 0, once * once / (2 * twice)).otherwise(once * (once - 1) / 2)
    known = (top.groupBy("query_id", "same").agg(F.count(F.lit(1)).alias("n"), F.bit_count(F.bit_or("on")).alias("hits"), F.min("score").alias("kth"))
             .groupBy("query_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct"), unseen.alias("unseen"), F.min("kth").alias("kth")))
    queries = rows.where("is_query").select(F.col("id").alias("query_id"), "v")
    open_ = store(queries.join(known.hint("merge"), "query_id", "left").where(
        F.col("n").isNull() | (F.col("n") < k) | (2 * F.col("distinct") < k) | (F.col("unseen") > missed * F.col("distinct")))
        .select("query_id", "v", F.when(F.col("n") >= k, F.col("kth")).alias("kth")), "ann-open")

    # the stated queries that are left against all blocks of the first ordering
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, best = [], None
        for b in slices(batches, 64):
            for is_block, i, kth, ids, v in zip(*(c.to_pylist() for c in b.columns)):
                if not is_block:  # they come first
                    asks.append((i, kth, v))
                    continue
                if best is None:
                    if not asks:
                        return
                    qid, floor, q = (list(c) for c in zip(*asks))
                    qid, q, best = np.array(qid, np.int64), _vectors(q, dtype, dim), Best(np.array(floor), k)
                    asks.clear()
                ids, x = np.frombuffer(ids, "<i8"), _vectors(v, dtype, dim)
                for at in range(0, len(qid), scan_groups):
                    some = slice(at, at + scan_groups)
                    n, j, s = best_of(q[some], qid[some], x, ids, k, best.floor[some])
                    best.add(n + at, ids[j], s)
                if not np.isfinite(best.floor).all():
                    best.cut()
        if best is not None:
            n, i, s = best.cut()
            yield pa.RecordBatch.from_arrays([pa.array(qid[n]), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])

    left = open_.count()
    every = top.select("query_id", "vec_id", "score")
    if left:
        facing = blocks.where((F.col("curve") == 0) & (F.length("ids") > 0))
        size = facing.agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("ids") / 8).cast("long").alias("vectors")).first()
        tall, wide = scan_grid(left, size.vectors, size.blocks, int(spark.conf.get("spark.sql.shuffle.partitions")), dim)
        tile = (F.col("row") * wide + F.col("column")).cast("int").alias("tile")
        asking = (open_.withColumn("row", F.pmod(F.xxhash64("query_id"), F.lit(tall)))
                  .withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
                  .select(tile, F.lit(False).alias("is_block"), F.col("query_id").alias("id"),
                          F.coalesce("kth", F.lit(float("-inf"))).alias("kth"), F.lit(None).cast("binary").alias("ids"), "v"))
        facing = (facing.withColumn("column", F.pmod("no", F.lit(wide)))
                  .withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(tall - 1))))
                  .select(tile, F.lit(True).alias("is_block"), F.lit(None).cast("long").alias("id"),
                          F.lit(None).cast("double").alias("kth"), "ids", F.col("vecs").alias("v")))
        tiles = asking.unionByName(facing).repartitionById(tall * wide, "tile").sortWithinPartitions("is_block")
        every = every.unionByName(tiles.select("is_block", "id", "kth", "ids", "v").mapInArrow(scan, out))
    late = open_.select("query_id", F.lit(True).alias("scanned"))
    every = every.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .join(late.hint("merge"), "query_id", "left")
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score",
                    F.coalesce("scanned", F.lit(False)).alias("scanned")))


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 20 against all others, 20 nearest each."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
