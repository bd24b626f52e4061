"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: 64 bits by majority of the XXH64 values of a text's word shingles. Two fingerprints
are linked when they differ in at most ``radius`` bits; components are taken over the links.

Search. The 64 bits are grouped into partitions of correlated bits; partition i gets its own
threshold t_i >= -1 (-1: not probed) with sum(t_i + 1) = radius + 1. By the pigeonhole principle
any two fingerprints within ``radius`` bits are within t_i bits in some partition i. Number of
partitions and thresholds are chosen by dynamic programming over the candidate counts estimated on
a bounded sample of fingerprints (``plan_rows``); the choice moves cost, never results. Each
distinct fingerprint is indexed once by its value in a partition and probes the values within t_i
bits; every candidate pair is verified on all 64 bits.

Full buckets. An index bucket with more than ``hot_bucket`` distinct fingerprints isn't paired.
Whoever lies in it or probes it writes its whole radius-1 ball instead (itself and its 64
one-bit neighbours): two fingerprints are within 2 bits exactly when their balls meet, and at most
65 fingerprints share a ball point, so the work stays proportional to the rows. (For another
radius r the ball has radius ceil(r/2) on both sides and the meeting pairs are verified.)

Rows. Copies share a fingerprint, so all search runs on distinct fingerprints.

Edge cases: null or wordless text has fingerprint 0 and is linked like any other; fewer words than
a shingle hash as one sequence; a null id never names a component unless all its ids are null;
repeated rows keep their own output row; other columns are not read, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajens.llm.common import free_name, slices, store, table
from trajens.llm.graph import components


def simhash64(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of one text (UTF-8 bytes)."""
    words = (text or b"").lower().split()  # bytes: lowers A-Z only, splits at ASCII white space
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    stops = (ends[shingle - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], seed) for s, e in zip(starts, stops)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at:at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3, seed: int = 42, hashed: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. One row per input row. If ``hashed``,
    also text_hash, which with the id names a document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([simhash64(t, shingle, seed) for t in b.column(1).to_pylist()],
                          dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("binary").alias("text"),
                       *([F.xxhash64(text_col).alias("text_hash")] if hashed else []))
    return rows.mapInArrow(run, "doc_id long, fp long" + (", text_hash long" if hashed else ""))


# --- planning on a bounded sample ------------------------------------------------------------

def _bits(fps: np.ndarray) -> np.ndarray:
    return ((fps[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int8)


def bit_groups(fps: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal size; each grows by the free bit most correlated with it."""
    x = _bits(fps).astype(float)
    x -= x.mean(axis=0)
    sd = np.sqrt((x * x).mean(axis=0)) + 1e-9
    corr = np.abs((x.T @ x) / max(1, len(x)) / np.outer(sd, sd))
    free, groups = set(range(64)), []
    for g in range(m):
        size = (64 - sum(map(len, groups))) // (m - g)
        group = [min(free)]
        free.discard(group[0])
        while len(group) < size:
            nxt = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(nxt)
            free.discard(nxt)
        groups.append(sorted(group))
    return groups


def plan(sample: np.ndarray, n: int, radius: int = 2, most_groups: int = 6) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the cheapest division, by dynamic programming over thresholds.

    Cost of threshold t in a group: probes written plus candidates expected among ``n``
    fingerprints (pairs of the sample within t bits in the group, scaled up)."""
    best_cost, best = float("inf"), [(list(range(64)), radius)]
    if len(sample) < 2:
        return best
    x = _bits(sample).astype(np.float32)
    pairs = len(sample) * (len(sample) - 1) / 2
    for m in range(1, most_groups + 1):
        groups, cost = bit_groups(sample, m), []
        for g in groups:
            y = x[:, g]
            s = y.sum(axis=1)
            hist = np.zeros(len(g) + 1)
            for at in range(0, len(y), 1024):  # Hamming distances of sample pairs, in blocks
                d = s[at:at + 1024, None] + s[None, :] - 2 * (y[at:at + 1024] @ y.T)
                hist += np.bincount(np.rint(d).astype(int).ravel(), minlength=len(g) + 1)[:len(g) + 1]
            hist[0] -= len(sample)
            within = np.cumsum(hist / 2)
            row = [0.0]
            for t in range(radius + 1):
                probes = sum(comb(len(g), j) for j in range(t + 1))
                share = max(within[min(t, len(g))] / pairs, probes / 2.0 ** len(g))
                row.append(n * probes + share * n * n / 2)
            cost.append(row)  # row[t + 1] is the cost of threshold t; row[0] of leaving it out
        budget = radius + 1
        table = [[0.0] + [float("inf")] * budget]
        for row in cost:
            table.append([min(table[-1][b - k] + row[k] for k in range(b + 1)) for b in range(budget + 1)])
        if table[-1][budget] < best_cost:
            best_cost, left, picks = table[-1][budget], budget, []
            for i in range(m, 0, -1):
                k = min(range(left + 1), key=lambda k: table[i - 1][left - k] + cost[i - 1][k])
                picks.append((groups[i - 1], k - 1))
                left -= k
            best = picks[::-1]
    return [(g, t) for g, t in best if t >= 0]


# --- probing ---------------------------------------------------------------------------------

def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _flips(bits, t: int) -> list[int]:
    """Masks with at most t of the given bits set, as signed longs; the empty mask first."""
    return [_signed(sum(1 << b for b in c)) for k in range(t + 1) for c in combinations(bits, k)]


def _exploded(df: DataFrame, bits, t: int) -> DataFrame:
    masks = F.array(*[F.lit(m) for m in _flips(bits, t)])
    return df.select("*", F.explode(masks).alias("_flip"))


def links(fps: DataFrame, radius: int = 2, plan_rows: int = 4096, hot_bucket: int = 64) -> DataFrame:
    """Links (a, b) among the distinct values of ``fps.fp``: a spanning set of all pairs within
    ``radius`` bits (same components; pairs inside full buckets come as stars)."""
    n = fps.count()
    # about plan_rows fingerprints by hash; they only set the division
    share = F.lit(int(min(1.0, plan_rows / max(1, n)) * (1 << 30)))
    chosen = fps.where(F.pmod(F.xxhash64(F.lit(1), "fp"), F.lit(1 << 30)) < share).collect()
    sample = np.array(sorted(r[0] for r in chosen), dtype=np.int64).view(np.uint64)
    parts = plan(sample, n, radius)
    index, probes = [], []
    for i, (bits, t) in enumerate(parts):
        mask = F.lit(_signed(sum(1 << b for b in bits)))
        key = F.col("fp").bitwiseAND(mask)
        index.append(fps.select(F.lit(i).alias("p"), key.alias("key"), "fp"))
        probe = _exploded(fps, bits, t)
        probes.append(probe.select(F.lit(i).alias("p"), key.bitwiseXOR(F.col("_flip")).alias("key"), "fp"))

    def union(dfs):
        out = dfs[0]
        for d in dfs[1:]:
            out = out.unionByName(d)
        return out

    idx, prb = union(index), union(probes)
    size = idx.groupBy("p", "key").agg(F.count(F.lit(1)).alias("n"))
    cold = size.where(F.col("n") <= hot_bucket).where("n > 0").select("p", "key")
    hot = size.where(F.col("n") > hot_bucket).select("p", "key")
    pairs = (idx.join(cold, ["p", "key"]).withColumnRenamed("fp", "a")
             .join(prb.withColumnRenamed("fp", "b"), ["p", "key"])
             .where("a < b and bit_count(a ^ b) <= " + str(int(radius))).select("a", "b"))
    swapped = (idx.join(cold, ["p", "key"]).withColumnRenamed("fp", "b")
               .join(prb.withColumnRenamed("fp", "a"), ["p", "key"])
               .where("a < b and bit_count(a ^ b) <= " + str(int(radius))).select("a", "b")
               ) if any(t > 0 for _, t in parts) else None
    near = prb.join(hot, ["p", "key"]).select("fp").distinct()
    half = (radius + 1) // 2
    balls = (_exploded(near, range(64), half)
             .select("fp", F.col("fp").bitwiseXOR(F.col("_flip")).alias("point")))
    if radius == 2:  # all fingerprints at a ball point are within 2 bits of each other
        met = balls.groupBy("point").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
        stars = (balls.join(met, "point").where("fp != b")
                 .select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b")))
    else:
        other = balls.select("point", F.col("fp").alias("b"))
        stars = (balls.withColumnRenamed("fp", "a").join(other, "point")
                 .where("a < b and bit_count(a ^ b) <= " + str(int(radius))).select("a", "b"))
    out = pairs.unionByName(stars)
    return out.unionByName(swapped) if swapped is not None else out


def _rooted(rows: DataFrame, first: Column, radius: int, plan_rows: int, hot_bucket: int) -> DataFrame:
    """(fp, first, root) per distinct fingerprint: ``first`` is taken over its rows, ``root`` is the
    same throughout a component."""
    fps = store(rows.groupBy("fp").agg(first.alias("first")), "simhash-fps")
    cc = components(links(fps.select("fp"), radius, plan_rows, hot_bucket), "simhash-links")
    return fps.join(cc, fps["fp"] == cc["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   radius: int = 2, seed: int = 42, plan_rows: int = 4096,
                   hot_bucket: int = 64) -> DataFrame:
    """(doc_id, fp, component_id) per input row; component_id is the smallest id reachable."""
    rows = store(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-rows")
    rooted = _rooted(rows, F.min("doc_id"), radius, plan_rows, hot_bucket)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 3, radius: int = 2, seed: int = 42, plan_rows: int = 4096,
                       hot_bucket: int = 64) -> DataFrame:
    """One row of ``docs`` per component: the least in (id, text hash), null ids last. Id and text
    hash together name a document, so different texts with one id go or stay each for itself; of
    repeated rows with one id and text, one stays. All columns are kept."""
    rows = store(fingerprints(docs, id_col, text_col, shingle, seed, hashed=True), "simhash-rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_hash").alias("hash")))
    rooted = _rooted(rows, least, radius, plan_rows, hot_bucket)
    keepers = rooted.groupBy("root").agg(F.min("first").alias("first"))
    own = {n: free_name(docs, f"_{n}") for n in ("none", "id", "hash")}
    theirs = {n: free_name(docs, f"_keep_{n}") for n in own}
    nth = free_name(docs, "_nth")
    at = F.col(id_col).cast("long")
    named = docs.withColumns({own["none"]: at.isNull(), own["id"]: F.coalesce(at, F.lit(0)), own["hash"]: F.xxhash64(text_col)})
    once = Window.partitionBy(*own.values()).orderBy(own["hash"])
    single = lambda d: d.withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1).drop(nth)
    keep = keepers.select(*[F.col("first")[n].alias(theirs[n]) for n in own])
    met = [F.col(own[n]) == F.col(theirs[n]) for n in own]
    known, unknown = named.where(F.col(id_col).isNotNull()), named.where(F.col(id_col).isNull())
    # join and window share one exchange and one sort; rows without an id may be many copies of one
    # text: they are cut by a per-group limit before their exchange
    return (single(known.join(keep, met, "left_semi")).unionByName(single(unknown).join(keep, met, "left_semi"))
            .drop(*own.values()))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """One row per document: fingerprint as 16 hex digits, smallest doc_id of its component."""
    g = simhash_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
