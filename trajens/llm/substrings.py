"""Exact removal of repeated byte strings with a logarithmic family of sampled suffix arrays.

A byte is removed when some ``length``-byte string that covers it also starts earlier (smaller id,
or same document and earlier start). All strings are judged on the input.

Sampled suffixes. Among the k-byte windows inside any ``length``-byte string, the one with the
least hash is its anchor, so equal strings have equal anchors at equal places. Starts of a document
with the same anchor form a run; together the runs hold every start once, about one run per 38
bytes. The suffix array of a batch is the table of its anchors' suffixes in order of
(first three bytes, 40-bit hash of the first k bytes), bucketed and sorted by that key, with the
hash of the whole bytes that the run's strings span (``span``), and where it lies.

Family. Documents come in batches. A batch gets its suffix array (equal (key, span) in it:
the first stays, the others are repeats in full), which is merge-scanned against every level of the
family by sort-merge semi joins on the bucketed key, without shuffling a level: a run whose (key, span)
a level has is a repeat in full; runs that share just the key (the strings differ somewhere in the
span, as at the edges of a common passage) are "mixed" and settled below. Then the batch becomes a
level, and before the next batch levels of equal size are merged, so n batches leave at most log n
levels and every entry is rewritten at most log n times. Semi joins never pair the members of a
group, however large.

Mixed runs are settled string by string: the first run of each (key, span) sends its bytes to its
key's task, where the strings' hashes are sorted with their places and all but the least place of
each are removed. Strings are equal when key and 64-bit hash are. This is linear in the runs, about
38 strings each. A key with more than ``group_rows`` different spans is too much for one task: its
strings are dealt out by their own hashes instead, and the least place per hash is a map-side
combined minimum.

Texts are shuffled once to meet their runs; those without any are finished there, and only the
touched ones are written for the last step.

Ids: with unique, non-null ids the id itself is key and order. Otherwise rows are ordered by id
(null first), then text hash; rows equal in both count as one document and get equal results.

Edge cases: null text counts as empty, documents shorter than ``length`` bytes lose nothing; very
long texts are scanned in overlapping slices; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajens.llm.common import partition_offsets, store, table

_U = np.uint64
_SLICE = 1 << 20
_POS = _U((1 << 24) - 1)


class Rolling:
    """Hashes of all windows of a text: sum of t[byte] * base^i modulo 2^64, from prefix sums."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.t = rng.integers(0, 1 << 64, 256, dtype=_U)
        self.base = int(rng.integers(0, 1 << 62)) * 4 + 3  # odd, so it has an inverse
        self.inverse = pow(self.base, -1, 1 << 64)
        self.power, self.back = np.ones(1, _U), np.ones(1, _U)

    def sums(self, b: np.ndarray) -> np.ndarray:
        while len(self.power) <= len(b):
            n = _U(pow(self.base, len(self.power), 1 << 64)), _U(pow(self.inverse, len(self.power), 1 << 64))
            self.power = np.concatenate([self.power, self.power * n[0]])
            self.back = np.concatenate([self.back, self.back * n[1]])
        p = np.zeros(len(b) + 1, _U)
        np.cumsum(self.t[b] * self.power[:len(b)], out=p[1:])
        return p

    def windows(self, p: np.ndarray, size: int) -> np.ndarray:
        n = len(p) - size
        return (p[size:] - p[:-size]) * self.back[:n]

    def spans(self, p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (p[end] - p[start]) * self.back[start]


def mixed_up(h: np.ndarray, salt: int) -> np.ndarray:
    """Spread all bits of a 64-bit hash (xor-shift and multiply)."""
    h = h ^ _U(salt)
    h = (h ^ (h >> _U(33))) * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(29))) * _U(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> _U(32))


def least_in_window(v: np.ndarray, w: int) -> np.ndarray:
    """min(v[i : i + w]) for every i, by running minima from both ends of blocks of w."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo(_U).max, _U)
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n - w + 1], head[w - 1:n])


_ONE, _TWO = Rolling(1), Rolling(2)


def runs(data: bytes, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(key, span, start, n) of every run of ``data``: starts start .. start + n - 1."""
    out = []
    for at in range(0, max(0, len(data) - length + 1), _SLICE):
        b = np.frombuffer(data, np.uint8, min(_SLICE + length - 1, len(data) - at), at)
        p, q = _ONE.sums(b), _TWO.sums(b)
        h = _ONE.windows(p, k)
        order = (mixed_up(h, 17) & ~_POS) | np.arange(len(h), dtype=_U)
        anchor = (least_in_window(order, length - k + 1) & _POS).astype(np.int64)
        s = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        n = np.diff(np.append(s, len(anchor)))
        m = anchor[s]
        first = (b[m].astype(_U) << _U(56)) | (b[m + 1].astype(_U) << _U(48)) | (b[m + 2].astype(_U) << _U(40))
        key = (first | (mixed_up(h[m], 29) >> _U(24))) ^ _U(1 << 63)  # byte order as signed order
        span = mixed_up(_TWO.spans(q, s, s + n + length - 1) + n.astype(_U) * _U(0xD6E8FEB86659FD93), 43)
        out.append((key.view(np.int64), span.view(np.int64), (s + at).astype(np.int64), n.astype(np.int32)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return tuple(np.concatenate(c) for c in zip(*out))


def strings(spans: list[bytes], n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of the span, offset) of the first ``n[i]`` strings of each span."""
    hashes, which, at = [], [], []
    for lo in range(0, len(spans), 4096):
        part, m = spans[lo:lo + 4096], n[lo:lo + 4096]
        b = np.frombuffer(b"".join(part), np.uint8)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        first = np.repeat(np.cumsum(sizes) - sizes, m)
        offset = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        start = first + offset
        hashes.append(mixed_up(_ONE.spans(_ONE.sums(b), start, start + length), 61).view(np.int64))
        which.append(np.repeat(np.arange(lo, lo + len(part)), m))
        at.append(offset)
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(which), np.concatenate(at)


def later_strings(key: np.ndarray, doc: np.ndarray, s: np.ndarray, n: np.ndarray, spans: list[bytes],
                  length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, n): intervals of starts whose string has an earlier place among these runs."""
    h, i, off = strings(spans, n, length)
    d, p, k = doc[i], s[i] + off, key[i]
    order = np.lexsort((p, d, h, k))
    h, d, p, k = h[order], d[order], p[order], k[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
    group = np.cumsum(fresh) - 1
    lead = np.flatnonzero(fresh)
    gone = (d != d[lead][group]) | (p != p[lead][group])
    d, p = d[gone], p[gone]
    order = np.lexsort((p, d))
    d, p = d[order], p[order]
    begin = np.ones(len(d), bool)
    begin[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1)
    at = np.flatnonzero(begin)
    last = np.append(at[1:], len(p)) - 1
    return d[at], p[at], p[last] - p[at] + 1 if len(at) else p[at]


# --- the family --------------------------------------------------------------------------------

def later_copies(key: np.ndarray, span: np.ndarray, doc: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which runs have an equal (key, span) at an earlier place among these."""
    order = np.lexsort((s, doc, span, key))
    k, p, d, a = key[order], span[order], doc[order], s[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    out = np.zeros(len(k), bool)
    out[order] = (d != d[lead]) | (a != a[lead])
    return out


def suffix_rows(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Runs of ``docs`` (doc, text as binary): (key, span, doc, s, n, dup). ``dup`` marks runs with an
    equal one earlier among the runs of a scan's batch: they are repeats whatever else there is, and no
    entry of the array. Their key no longer matters and becomes a hash of their place, so the copies
    of one frequent passage don't all go to its key's task; their span becomes 0."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, docs_, counts, size = [], [], [], 0
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = runs(t or b"", length, k)
                held.append(r)
                docs_.append(doc)
                counts.append(len(r[0]))
                size += len(r[0])
                if size >= 400_000:
                    yield pack(held, docs_, counts)
                    held, docs_, counts, size = [], [], [], 0
            if size:
                yield pack(held, docs_, counts)

    def pack(held, docs_, counts):
        key, span, s, n = (np.concatenate(c) for c in zip(*held))
        doc = np.repeat(np.array(docs_, np.int64), counts)
        dup = later_copies(key, span, doc, s)
        place = mixed_up(mixed_up(doc.view(_U), 71) + s.view(_U), 73).view(np.int64)
        columns = (np.where(dup, place, key), np.where(dup, 0, span), doc, s, n, dup)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "span", "doc", "s", "n", "dup"])

    return docs.select("doc", "text").mapInArrow(scan, "key long, span long, doc long, s long, n int, dup boolean")


class SuffixFamily:
    """Levels of suffix arrays; ``add`` scans a batch of later documents against all of them.

    Levels are bucketed tables in the session's warehouse (shared by the executors); ``close``
    drops them. ``repeats`` and ``mixed`` gather what the scans found, in the shared folder."""

    def __init__(self, spark, length: int = 100, k: int = 24):
        self.spark, self.length, self.k = spark, length, k
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str]] = []  # (batches in it, table)
        self.repeats: DataFrame | None = None
        self.mixed: DataFrame | None = None

    def _write(self, df: DataFrame) -> str:
        name = f"suffixes_{uuid.uuid4().hex}"
        (df.write.option("compression", "zstd").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name))
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _merge_equal(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] >= self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            both = self.spark.table(a).where("not dup").unionByName(self.spark.table(b).where("not dup"))
            self.levels.append((n + m, self._write(both.repartition(self.buckets, "key"))))
            self._drop(a)
            self._drop(b)

    def add(self, docs: DataFrame) -> None:
        """``docs``: (doc, text as binary), all later than what the family has."""
        # tables bucketed by key are co-partitioned for joins on (key, span), too; by default Spark
        # shuffles them again by all join keys. Everything in here runs before the setting goes back
        setting = "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "false")
        try:
            self._add(docs)
        finally:
            self.spark.conf.set(setting, before)

    def _add(self, docs: DataFrame) -> None:
        self._merge_equal()
        rows = suffix_rows(docs, self.length, self.k).repartition(self.buckets, "key")
        same = Window.partitionBy("key", "span").orderBy("doc", "s")
        marked = rows.withColumn("dup", F.col("dup") | (F.dense_rank().over(same) > 1))
        new = self._write(marked.withColumn("span", F.when(F.col("dup"), 0).otherwise(F.col("span"))))
        batch = self.spark.table(new)
        where = ["doc", "s", "n"]
        place = ["key", *where]
        found, unsettled = [batch.where("dup").select(*where)], []
        fresh = batch.where("not dup")
        for _, name in self.levels:
            level = self.spark.table(name).where("not dup")
            found.append(fresh.join(level.select("key", "span"), ["key", "span"], "left_semi").select(*where))
            fresh = fresh.join(level.select("key", "span"), ["key", "span"], "left_anti")
        for _, name in self.levels:
            level = self.spark.table(name).where("not dup")
            unsettled += [fresh.join(level.select("key"), "key", "left_semi").select(*place),
                          level.join(fresh.select("key"), "key", "left_semi").select(*place)]
        several = (fresh.groupBy("key").agg(F.min("span").alias("lo"), F.max("span").alias("hi"))
                   .where("lo < hi").select("key"))
        unsettled.append(fresh.join(several, "key", "left_semi").select(*place))
        for have, parts in (("repeats", found), ("mixed", unsettled)):
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            out = store(out, f"suffix-{have}")
            before = getattr(self, have)
            setattr(self, have, out if before is None else before.unionByName(out))
        self.levels.append((1, new))

    def close(self) -> None:
        for _, name in self.levels:
            self._drop(name)
        self.levels = []


# --- documents ---------------------------------------------------------------------------------

def _numbered(docs: DataFrame) -> DataFrame:
    """``doc``: the id where ids are unique and not null, else the rank of (id, text hash).
    ``docs``: (id, text as binary)."""
    n, known = docs.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    if n == known:
        return docs.withColumn("doc", F.col("id"))
    hashed = docs.withColumn("h", F.xxhash64("text"))
    names = hashed.select("id", "h").distinct()
    ranged = store(names.repartitionByRange("id", "h").withColumn("pid", F.spark_partition_id()), "doc-ranks")
    before = partition_offsets(ranged.groupBy("pid").agg(F.count(F.lit(1)).alias("n")), "pid", "n")
    local = F.row_number().over(Window.partitionBy("pid").orderBy("id", "h"))
    # one row per range partition
    ranks = (ranged.withColumn("local", local).join(F.broadcast(before), "pid")
             .select(F.col("id").alias("r_id"), F.col("h").alias("r_h"), (F.col("_before") + F.col("local")).alias("doc")))
    return (hashed.join(ranks, F.col("id").eqNullSafe(F.col("r_id")) & F.col("h").eqNullSafe(F.col("r_h")))
            .select("id", "text", "doc"))


def kept_bytes(data: bytes, covered: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left); ``covered``: [start, end) in any order."""
    parts, at, gone, n, end = [], 0, 0, 0, -1
    for s, e in sorted(covered):
        if s > end:
            n += 1
            parts.append(data[at:s])
        gone += max(0, e - max(s, end))
        end = max(end, e)
        at = end
    return gone, n, b"".join([*parts, data[at:]])


def _settle(open_: DataFrame, length: int, group_rows: int) -> DataFrame:
    """(doc, s, n): starts to remove among the mixed runs of ``open_`` (doc, text, and lists of
    starts, lengths and keys)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, s, n, key in zip(*(b.column(i).to_pylist() for i in range(5))):
                at = dict(zip(s, zip(key, n)))  # a run met in several scans counts once
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in at.values()], pa.int64()), pa.array([doc] * len(at), pa.int64()),
                     pa.array(list(at), pa.int64()), pa.array([m for _, m in at.values()], pa.int64()),
                     pa.array([text[p:p + m + length - 1] for p, (_, m) in at.items()], pa.binary())], schema=run_schema)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, full = [], None  # rows of the keys at hand; the key that outgrew its task

        def columns(rows):
            key, doc, s, n, raw = zip(*rows)
            return np.array(key), np.array(doc), np.array(s), np.array(n), list(raw)

        def done(rows):
            d, p, m = later_strings(*columns(rows), length)
            empty = np.zeros(len(d), bool)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(d), np.int64), mask=~empty), pa.array(d), pa.array(p), pa.array(m),
                 pa.nulls(len(d), pa.binary())], schema=run_schema)

        def pass_on(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), run_schema)], schema=run_schema)

        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(5))))
            if full is not None:
                own = [r for r in rows if r[0] == full]
                if own:
                    yield pass_on(own)
                    rows = rows[len(own):]
            held += rows
            if held:
                last = held[-1][0]
                open_rows = [r for r in held if r[0] == last]
                if len(held) > len(open_rows):
                    yield done(held[:-len(open_rows)])
                held = open_rows
                if len(held) > group_rows:
                    yield pass_on(held)
                    full, held = last, []
        if held:
            yield done(held)

    run_schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("s", pa.int64()), ("n", pa.int64()), ("span", pa.binary())])
    columns = "key long, doc long, s long, n long, span binary"
    by_key = open_.mapInArrow(cut, columns).repartition("key").sortWithinPartitions("key")
    settled = store(by_key.mapInArrow(settle, columns), "suffix-settled")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, doc, s, n = (b.column(i).to_numpy() for i in range(4))
            for lo in range(0, b.num_rows, 4096):
                h, i, off = strings(b.column(4).slice(lo, 4096).to_pylist(), n[lo:lo + 4096], length)
                i = i + lo
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[i], h, doc[i], s[i] + off)],
                                                 names=["key", "h", "doc", "s"])

    single = settled.where("span is not null").mapInArrow(explode, "key long, h long, doc long, s long")
    least = (single.groupBy("key", "h").agg(F.min(F.struct("doc", "s")).alias("low"), F.max(F.struct("doc", "s")).alias("high"))
             .where("low != high").select("key", "h", "low"))
    rest = (single.join(least, ["key", "h"]).where(F.struct("doc", "s") != F.col("low"))
            .select("doc", "s", F.lit(1).cast("long").alias("n")))
    return settled.where("span is null").select("doc", "s", "n").unionByName(rest)


_DONE = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = 100, k: int = 24, batches: int = 4,
                   group_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per input row; ``with_text``
    adds ``kept``, the bytes that are left.

    The table is loaded in ``batches`` parts of near-equal size in id order."""
    spark = docs.sparkSession
    rows = _numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")))
    edges = rows.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 10000)).first()[0] or []
    family = SuffixFamily(spark, length, k)
    lower = None
    try:
        for upper in [*sorted(set(edges)), None]:
            part = rows
            if lower is not None:
                part = part.where(F.col("doc") > lower)
            if upper is not None:
                part = part.where(F.col("doc") <= upper)
            family.add(part)
            lower = upper
    finally:
        family.close()
    repeats, mixed = family.repeats, family.mixed

    repeats = repeats.withColumn("key", F.lit(None).cast("long"))  # only mixed runs need theirs
    found = (repeats.withColumn("settled", F.lit(True)).unionByName(mixed.withColumn("settled", F.lit(False)))
             .groupBy("doc").agg(*[F.collect_list(F.when(F.col("settled") == v, F.struct("s", "n", "key"))).alias(c)
                                   for c, v in (("gone", True), ("open", False))]))
    met = rows.join(found.withColumnRenamed("doc", "f_doc"), F.col("doc") == F.col("f_doc"), "left")
    kept_type = ", kept binary" if with_text else ""

    def row(id_, data, covered):
        gone, n, left = kept_bytes(data, covered)
        return (id_, len(data), gone, n, hashlib.sha256(left).hexdigest(), *([left] if with_text else []))

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_text else [])]
    done_schema = pa.schema(list(zip(names, types)))

    def batch_of(rows_):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows_), types)], schema=done_schema) \
            if rows_ else pa.RecordBatch.from_arrays([pa.array([], t) for t in types], schema=done_schema)

    # texts that hold no shared run are finished where they meet that fact
    extra = [("doc", pa.int64()), ("text", pa.binary()), ("gone", pa.list_(pa.int64())), ("gone_n", pa.list_(pa.int64())),
             ("open", pa.list_(pa.int64())), ("open_n", pa.list_(pa.int64())), ("open_key", pa.list_(pa.int64()))]
    first_schema = pa.schema([*done_schema, *[pa.field(n, t) for n, t in extra]])

    def first(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            out = []
            for id_, doc, text, g, gn, o, on, ok in zip(*(b.column(i).to_pylist() for i in range(8))):
                if g or o:
                    out.append((id_, *[None] * (len(names) - 1), doc, text or b"", g, gn, o, on, ok))
                else:
                    out.append((*row(id_, text or b"", []), *[None] * len(extra)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), first_schema)],
                                             schema=first_schema) if out else pa.RecordBatch.from_pylist([], schema=first_schema)

    staged = store(met.select("id", "doc", "text", F.col("gone.s").alias("gone"), F.col("gone.n").cast("array<long>").alias("gone_n"),
                              F.col("open.s").alias("open"), F.col("open.n").cast("array<long>").alias("open_n"),
                              F.col("open.key").alias("open_key"))
                   .mapInArrow(first, _DONE + kept_type + ", doc long, text binary, gone array<long>, gone_n array<long>, "
                               "open array<long>, open_n array<long>, open_key array<long>"), "suffix-texts")
    touched = staged.where("doc is not null")
    single = _settle(touched.where(F.size("open") > 0).select("doc", "text", "open", "open_n", "open_key"), length, group_rows)
    again = (single.groupBy("doc").agg(F.collect_list(F.struct("s", "n")).alias("late")).withColumnRenamed("doc", "a_doc"))

    def last(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            out = []
            for id_, text, g, gn, late, late_n in zip(*(b.column(i).to_pylist() for i in range(6))):
                starts = [*zip(g or [], gn or []), *zip(late or [], late_n or [])]
                out.append(row(id_, text, [(s, s + n + length - 1) for s, n in starts]))
            yield batch_of(out)

    settled = (touched.join(again, F.col("doc") == F.col("a_doc"), "left")
               .select("id", "text", "gone", "gone_n", F.col("late.s").alias("late"), F.col("late.n").alias("late_n"))
               .mapInArrow(last, _DONE + kept_type))
    return (staged.where("doc is null").select(*names).unionByName(settled)
            .withColumnRenamed("id", "doc_id"))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, strings of 100 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"))
