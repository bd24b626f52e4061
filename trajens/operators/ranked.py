"""Order statistics of groups without gathering a large group in one task.

Rows are counted per group first. Groups of at most ``most`` rows are dealt out by group and read
in order by one window each: one exchange, and no task holds more of a group than that bound. Larger
groups are cut into ordered chunks instead:

1. Equal values of a group are summed up first (combined map-side), so ties
   cost one row however many there are.
2. The chunk of a value is a fixed, order-preserving function of the value
   (:func:`chunk_of`: 256 chunks per power of two). Chunks that still hold more than ``most``
   distinct values (large counts, values with an offset) are split at value bounds, and those
   parts again until none is over the bound. The bounds are written to the shared folder before
   they are used, so every branch and every retry of a plan puts a row in the same chunk.
3. Inside each (group, chunk) running sums and the next value by ordinary
   windows.
4. A chunk table (one row per group and chunk) gives each chunk the totals of
   the chunks before it, the group totals, and the first value of the next
   chunk.

Keys that multiply the rows (forecast dates) can be given as *late* keys: they stay an array per
row until the rows have been dealt out, so the multiplied rows of groups within the bound are never
exchanged. Larger groups are multiplied first, and their ties combined map-side.

Input is read twice (counts, then rows): store it first where it is costly to compute.

Group keys travel as one struct column: a struct equals another where both
have NULL in the same field, so NULL group keys are groups of their own in
the join, too, without NULL-safe join keys (which would shuffle both sides
again).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajens.functions.quantiles import QUANTILE_LEVELS, label
from trajens.session import materialize

_PER_OCTAVE = 256
_CENTRE = 1100 * _PER_OCTAVE   # exponents of doubles lie within +-1075
_LAST = 3 * _CENTRE            # infinities and NaN, which sort last
#: rows of a group (distinct values of a chunk) that one task may hold
MOST = 1 << 16
_PIECES = 256


def chunk_of(x: Column) -> Column:
    """Order-preserving chunk number of a double: the larger the value the
    larger (or equal) its chunk."""
    size = F.floor(F.log2(F.abs(x)) * _PER_OCTAVE).cast("int") + _CENTRE
    return (F.when(F.isnan(x) | (x == float("inf")), F.lit(_LAST))
            .when(x == float("-inf"), F.lit(-_LAST))
            .when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size))


@dataclass(frozen=True)
class Late:
    """Key columns ``names`` that come of expanding ``column`` (an array) once the rows are dealt out:
    ``expand(array, keys)`` gives an array of structs ``h`` (the key columns) and ``w`` (a weight);
    ``keys`` is the struct of the group's other keys."""

    names: tuple[str, ...]
    column: str
    expand: Callable[[Column, Column], Column]


def shuffle_partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def large_groups(rows: DataFrame, most: int) -> DataFrame | None:
    """Stored table of the groups ``_g`` with more than ``most`` rows, None if there are none."""
    big = materialize(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most), "large-groups")
    return None if big.isEmpty() else big.select("_g")


def part_of(cuts: str, x: Column) -> Column:
    """Number of ``cuts`` (sorted) below ``x``, by bisection; 0 where there are none."""
    start = F.struct(F.lit(0).alias("lo"), F.coalesce(F.size(cuts), F.lit(0)).alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        right = F.get(cuts, mid) < x
        open_ = a["lo"] < a["hi"]
        return F.struct(F.when(open_ & right, mid + 1).otherwise(a["lo"]).alias("lo"),
                        F.when(open_ & ~right, mid).otherwise(a["hi"]).alias("hi"))

    return F.when(F.col(cuts).isNull(), F.lit(0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, halve, lambda a: a["lo"]))


def split_points(values: DataFrame, most: int) -> DataFrame | None:
    """Stored table (_g, _c, _cuts) of the chunks with more than ``most`` distinct values: sorted
    values at which to split them, so that no part is over the bound. None if no chunk is. ``values``:
    distinct (_g, _x), read once per round; a round splits each part into up to 256."""
    levels = F.array(*[F.lit(i / _PIECES) for i in range(1, _PIECES)])
    values = values.select("_g", "_x", chunk_of(F.col("_x")).alias("_c"))
    table = None
    while True:
        placed = values if table is None else values.join(table, ["_g", "_c"])
        part = F.lit(0) if table is None else part_of("_cuts", F.col("_x"))
        over = (placed.withColumn("_s", part).groupBy("_g", "_c", "_s")
                .agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_x", levels, 10 * _PIECES).alias("q"))
                .where(F.col("n") > most))
        pieces = F.least(F.lit(_PIECES), F.ceil(2 * F.col("n") / most)).cast("int")
        picked = F.transform(F.sequence(F.lit(1), pieces - 1), lambda i: F.get("q", F.floor(i * _PIECES / pieces).cast("int") - 1))
        new = materialize(over.groupBy("_g", "_c").agg(F.flatten(F.collect_list(picked)).alias("_cuts")), "split-points")
        if new.isEmpty():
            return table
        both = new if table is None else table.unionByName(new)
        table = materialize(both.groupBy("_g", "_c").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("_cuts")))).alias("_cuts")), "split-points")


def _summed(rows: DataFrame, group) -> DataFrame:
    """One row per group and distinct value."""
    return rows.groupBy(*group, "_x").agg(
        F.count(F.lit(1)).alias("_k"), F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_w")).alias("_w2"),
        F.max(F.col("_w").isNull().cast("int")).alias("_b"))


_POSITION = ["_x", "_k", "_rank", "_cw", "_pw", "_nx", "_n", "_sw", "_sw2", "_bad"]


def _whole(rows: DataFrame, group) -> DataFrame:
    """Positions in groups that one task may hold; ``rows`` are dealt out by (some of) ``group``."""
    order, whole = Window.partitionBy(*group).orderBy("_x"), Window.partitionBy(*group)
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = (_summed(rows, group)
              .withColumn("_rank", F.sum("_k").over(run)).withColumn("_cw", F.coalesce(F.sum("_w").over(run), F.lit(0.0)))
              .withColumn("_nx", F.lead("_x").over(order)))
    return (placed.withColumn("_pw", F.coalesce(F.lag("_cw").over(order), F.lit(0.0)))
            .withColumn("_n", F.sum("_k").over(whole)).withColumn("_sw", F.sum("_w").over(whole))
            .withColumn("_sw2", F.sum("_w2").over(whole)).withColumn("_bad", F.max("_b").over(whole))
            .select(*group, *_POSITION))


def _chunked(rows: DataFrame, group, most: int, series: DataFrame) -> DataFrame:
    """Positions in groups of any size; ``series``: distinct (_g, _x), whose chunks are split."""
    split = split_points(series, most)
    values = _summed(rows, group).withColumn("_c", chunk_of(F.col("_x")))
    if split is None:
        values = values.withColumn("_s", F.lit(0))
    else:
        values = values.join(split, ["_g", "_c"], "left").withColumn("_s", part_of("_cuts", F.col("_x"))).drop("_cuts")
    place = [*group, "_c", "_s"]
    chunk = Window.partitionBy(*place).orderBy("_x")
    run = chunk.rowsBetween(Window.unboundedPreceding, 0)
    local = (values.withColumn("_lk", F.sum("_k").over(run)).withColumn("_lw", F.sum("_w").over(run))
             .withColumn("_lnx", F.lead("_x").over(chunk)))
    local = local.withColumn("_lpw", F.lag("_lw").over(chunk))
    chunks = values.groupBy(*place).agg(
        F.sum("_k").alias("_k"), F.sum("_w").alias("_w"), F.sum("_w2").alias("_w2"), F.max("_b").alias("_b"),
        F.min("_x").alias("_first"))
    seq, whole = Window.partitionBy(*group).orderBy("_c", "_s"), Window.partitionBy(*group)
    before = seq.rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(
        *place,
        F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_ok"),
        F.coalesce(F.sum("_w").over(before), F.lit(0.0)).alias("_ow"),
        F.lead("_first").over(seq).alias("_onx"),
        F.sum("_k").over(whole).alias("_n"), F.sum("_w").over(whole).alias("_sw"),
        F.sum("_w2").over(whole).alias("_sw2"), F.max("_b").over(whole).alias("_bad"))
    return (local.join(offsets, place)
            .withColumn("_rank", F.col("_ok") + F.col("_lk")).withColumn("_nx", F.coalesce("_lnx", "_onx"))
            .withColumn("_cw", F.col("_ow") + F.coalesce("_lw", F.lit(0.0)))
            .withColumn("_pw", F.col("_ow") + F.coalesce("_lpw", F.lit(0.0)))
            .select(*group, *_POSITION))


def positions(df: DataFrame, keys, x: str, weight: str | None = None, most: int = MOST,
              late: Late | None = None) -> tuple[DataFrame, list[str], list[Column]]:
    """The rows of :func:`ordered_positions` by their group columns, those columns' names, and the
    keys as columns of them. Grouping by those columns needs no further exchange of small groups."""
    keys = list(keys)
    given = df.where(F.col(x).isNotNull())
    g, v = F.struct(*keys).alias("_g"), F.col(x).cast("double").alias("_x")
    if late:
        group, rows = ["_g", "_h"], given.select(g, v, F.col(late.column).alias("_late"))
        out = [*[F.col("_g")[k].alias(k) for k in keys], *[F.col("_h")[k].alias(k) for k in late.names]]
    else:
        w = (F.col(weight) if weight else F.lit(1.0)).cast("double")
        group, rows = ["_g"], given.select(g, v, w.alias("_w"))
        out = [F.col("_g")[k].alias(k) for k in keys]

    def multiplied(r: DataFrame) -> DataFrame:
        if not late:
            return r
        return (r.select("_g", "_x", F.explode(late.expand(F.col("_late"), F.col("_g"))).alias("_e"))
                .select("_g", "_x", F.col("_e.h").alias("_h"), F.col("_e.w").cast("double").alias("_w")))

    big = large_groups(rows.select("_g"), most)
    small = rows if big is None else rows.join(big, "_g", "left_anti")
    # rows that multiply are dealt into all shuffle partitions: their size before says little
    dealt = small.repartition(shuffle_partitions(df.sparkSession), "_g") if late else small.repartition("_g")
    pos = _whole(multiplied(dealt), group)
    if big is not None:
        hot = rows.join(big, "_g", "left_semi")
        pos = pos.unionByName(_chunked(multiplied(hot), group, most, hot.select("_g", "_x").distinct()))
    return pos, group, out


def ordered_positions(df: DataFrame, keys, x: str, weight: str | None = None, most: int = MOST) -> DataFrame:
    """One row per group and distinct value: keys, ``_x``, ``_k`` (rows with the
    value), ``_rank`` (position of the last of them, 1-based), ``_cw`` (running
    weight, inclusive), ``_pw`` (the same before this value), ``_nx`` (next value in the group, NULL at
    the last), ``_n``, ``_sw``, ``_sw2`` (group count, sum of weights and of squared
    weights) and ``_bad`` (1 if the group has a NULL weight). Rows with a
    NULL value are dropped (as quantiles skip them)."""
    pos, _, out = positions(df, keys, x, weight, most)
    return pos.select(*out, *_POSITION)


def levels_array(levels) -> Column:
    return F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(label(p)).alias("q")) for p in levels])


def type7(p: Column) -> Column:
    """Type-7 quantile at level ``p`` at the position that answers it: position ``h = (n-1)p``, between
    this value and the next one."""
    h = p * (F.col("_n") - 1).cast("double")
    lo, hi = F.floor(h), F.ceil(h)
    # the upper neighbour (rank ceil(h) + 1) is this value too unless it lies past the last of them
    own = (lo == hi) | (hi < F.col("_rank")) | (F.col("_x") == F.col("_nx"))
    return F.when(own, F.col("_x")).otherwise((hi - h) * F.col("_x") + (h - lo) * F.col("_nx"))


def ranked_hits(levels) -> Column:
    """Of a position, the levels it answers (type 7, same arithmetic as Spark's ``percentile``), as
    structs of level, label and value: the value that holds rank ``floor((n-1)p)+1`` answers p."""
    n1 = (F.col("_n") - 1).cast("double")
    hits = F.filter(levels_array(levels), lambda e: (F.floor(e["p"] * n1) < F.col("_rank"))
                    & (F.floor(e["p"] * n1) >= F.col("_rank") - F.col("_k")))

    return F.transform(hits, lambda e: F.struct(e["p"].alias("p"), e["q"].alias("q"), type7(e["p"]).alias("value")))


def ranked_quantiles(df: DataFrame, keys, value: str, levels=QUANTILE_LEVELS,
                     with_count: bool = False, most: int = MOST, late: Late | None = None) -> DataFrame:
    """Type-7 quantiles. Each row looks up the (usually zero) levels it answers with a higher-order
    ``filter``: no per-level explode of the rows, no further shuffle."""
    pos, _, out = positions(df, keys, value, most=most, late=late)
    names = [*keys, *(late.names if late else ())]
    extra = [F.col("_n").alias("n")] if with_count else []
    # the keys leave their struct below the explode: above it, column pruning may lose track of them
    return (pos.select(*out, *extra, ranked_hits(levels).alias("_hits"))
            .select(*names, *(["n"] if with_count else []), F.explode("_hits").alias("lv"))
            .select(*names, *(["n"] if with_count else []), F.col("lv.p").alias("quantile_level"),
                    F.col("lv.q").alias("quantile"), F.col("lv.value").alias("value")))
