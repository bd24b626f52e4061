"""Mixing sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
``share`` times all words; a target stops at ``cap`` times its source's words and the excess is
reshared by weight (water level over the sorted caps, one window over the table of sources).

Rates: among all document rates r in [0, cap] with sum(r * size) = target in each source, those
with least relative entropy to one copy each are r = min(cap, exp(lambda * size / scale)), one dual
variable per source. The convex dual is solved by Newton steps kept inside a bracket; each step is
one distributed aggregate over the (source, size) counts joined with the table of duals, and
only the largest relative error comes to the driver. Sums are taken in decimals, so the order of
tasks can't change a digit and reruns agree.

Copies: rates become whole numbers of 2^-20; documents are ordered by source, falling size and
hash, and running sums over that order (range partitions with offsets, so a hot source is spread)
round systematically: copies are floor or ceil of the rate. What a source then lacks or has over
its rounded target is given to or taken from the first documents with room for it; at most the
last of these is cut, so taken words meet the target to the word, and no document exceeds cap
times its size.

Edge cases: null or wordless text has size 0 and takes nothing; a null source is a source of its
own; a source without words has target 0; repeated rows and null ids each keep their row; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajens.llm.common import SPACE, free_name, store, table

_WORD = r"[^\x20\x09-\x0D]+"
_UNIT = 1 << 20


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights=(5, 2, 1)) -> DataFrame:
    """``sizes``: (source, source_size), one row per source. Adds ``target``. The windows run over
    this table of sources, never over documents."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("cap_at", cap * F.col("source_size") / F.col("w"))
    everyone = Window.partitionBy(F.lit(1))
    rising = Window.partitionBy(F.lit(1)).orderBy("cap_at", F.col("source").isNull(), "source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    # level if exactly the sources before this one stop at their caps; right at the first row where
    # the level does not exceed the row's own cap
    level = ((share * F.sum("source_size").over(everyone) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
             / (F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    rows = rows.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("cap_at"), F.struct("cap_at", F.col("source").isNull(), "source", "level"))).over(everyone)
    return rows.withColumn("water", first["level"]).select(
        "source", "source_size",
        F.least(cap * F.col("source_size"), F.coalesce(F.col("water") * F.col("w"), cap * F.col("source_size")))
        .cast("double").alias("target"))


def duals(sizes: DataFrame, goals: DataFrame, cap: float = 2.0, tolerance: float = 1e-9,
          most_steps: int = 200) -> DataFrame:
    """(source, scale, lam): solved dual per source. ``sizes``: (source, size, n) counts of
    documents; ``goals``: (source, source_size, target)."""
    big = F.lit(1e15)
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    scale = sizes.groupBy("source").agg(F.max("size").cast("double").alias("scale"))
    state = (goals.alias("g").join(scale.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source")))
             .select("g.source", "target", "scale", F.when(full, big).otherwise(F.lit(0.0)).alias("lam"),
                     F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
                     full.alias("done")))
    state = store(state, "mix-duals")
    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    for _ in range(most_steps):
        x = F.col("size") / F.col("scale")
        rate = F.least(F.lit(float(cap)), F.exp(F.col("lam") * x))
        words = F.col("n") * F.col("size")
        free = F.col("lam") * x < F.log(F.lit(float(cap)))
        sums = (sizes.alias("z").join(state.where("not done").alias("t"), F.col("z.source").eqNullSafe(F.col("t.source")))
                .groupBy("t.source").agg(exact(words * rate).alias("got"),
                                         exact(F.when(free, words * rate * x).otherwise(0)).alias("slope")))
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        inside = newton.isNotNull() & (F.col("new_lo").isNull() | (newton > F.col("new_lo"))) & (
            F.col("new_hi").isNull() | (newton < F.col("new_hi")))
        # no bracket yet: Newton step, at most a ten-fold reach; bracket but step outside: halve
        reach = 10.0 * (1 + F.abs("lam"))
        bounded = F.least(F.greatest(newton, F.col("lam") - reach), F.col("lam") + reach)
        wide = F.when(gap < 0, F.col("lam") + reach).otherwise(F.col("lam") - reach)
        mid = (F.col("new_lo") + F.col("new_hi")) / 2
        step = F.when(inside, bounded).otherwise(F.coalesce(mid, wide))
        near = F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
        state = store(
            state.alias("t").join(sums.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")), "left")
            .select("t.*", "got", "slope").withColumn("new_lo", lo).withColumn("new_hi", hi)
            .select("source", "target", "scale",
                    F.when(F.col("done") | near | F.col("got").isNull(), F.col("lam")).otherwise(step).alias("lam"),
                    F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"),
                    (F.col("done") | F.coalesce(near, F.lit(True))).alias("done")), "mix-duals")
        if state.where("not done").isEmpty():
            return state.select("source", "scale", "lam")
    raise RuntimeError(f"the dual did not converge in {most_steps} steps")


def _running(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Adds ``name``: sum of ``value`` over the rows before, in source order. ``df`` has ``pid``,
    the range partition it was written by; a window holds one source's rows of one partition."""
    chunk = Window.partitionBy("source", "pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("source", "pid").agg(F.sum(value).alias("t"))
    before = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("o_source"), F.col("pid").alias("o_pid"),
                            F.coalesce(F.sum("t").over(before), F.lit(0)).alias("o"))
    return (df.withColumn("l", F.coalesce(F.sum(value).over(chunk), F.lit(0)))
            .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("pid") == F.col("o_pid")))
            .withColumn(name, F.col("o") + F.col("l")).drop("o", "l", "o_source", "o_pid"))


def mix(docs: DataFrame, share: float = 1.5, cap: int = 2, weights=(5, 2, 1), seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, text_hash, size, source, source_size, target, rate, copies, taken), one row per
    input row."""
    text = F.col(text_col)
    rows = store(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                             F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
                             F.xxhash64(text).alias("text_hash")), "mix-rows")
    sizes = store(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = store(targets(totals, share, float(cap), weights), "mix-targets")
    lam = duals(sizes, goals, float(cap))
    plan = store(goals.alias("g").join(lam.alias("l"), F.col("g.source").eqNullSafe(F.col("l.source")))
                 .select("g.source", "source_size", "target", "scale", "lam"), "mix-plan")

    order = [F.desc("size"), "key", "doc_id", "text_hash"]
    key = F.xxhash64(F.lit(seed), "doc_id", "text_hash")
    ranged = (rows.withColumn("key", key).repartitionByRange("source", *order)
              .withColumn("pid", F.spark_partition_id()))
    # the partition number is written with the rows: later reads can't see another one
    ranged = store(ranged, "mix-ordered")
    rate = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size") / F.col("scale"))))
    rated = (ranged.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
             .select("r.*", "source_size", "target", rate.alias("rate"))
             .withColumn("units", F.round(F.col("rate") * _UNIT).cast("long")))
    start = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit(""))), F.lit(_UNIT))
    summed = _running(rated, order, "units", "before").withColumn("u", start)
    whole = lambda c: F.floor(c / F.lit(_UNIT))
    rounded = store(summed.withColumn("copies", (whole(F.col("before") + F.col("units") + F.col("u"))
                                                 - whole(F.col("before") + F.col("u"))).cast("long"))
                    .drop("before", "units", "u"), "mix-copies")
    left = (rounded.groupBy("source").agg((F.round(F.first("target")).cast("long")
                                           - F.sum(F.col("copies") * F.col("size"))).alias("left"))
            .withColumnRenamed("source", "l_source"))
    left = store(left, "mix-left")  # of known size: documents needn't be dealt out by source to meet it
    room = (rounded.join(left, F.col("source").eqNullSafe(F.col("l_source"))).drop("l_source")
            .withColumn("room", F.when(F.col("left") > 0, (cap - F.col("copies")) * F.col("size"))
                        .otherwise(F.col("copies") * F.col("size"))))
    placed = _running(room, order, "room", "used")
    part = F.greatest(F.lit(0), F.least(F.col("room"), F.abs("left") - F.col("used")))
    taken = F.col("copies") * F.col("size") + F.signum(F.col("left").cast("double")).cast("long") * part
    return placed.select("doc_id", "text_hash", "size", "source", "source_size", "target", "rate", "copies",
                         taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, a cut one up to its last taken
    word. Columns of ``docs``. Rows equal in id and text are written from one of them."""
    plan = mix(docs, id_col=id_col, text_col=text_col, **options)
    per = plan.where("taken > 0").groupBy("doc_id", "text_hash").agg(
        F.max("size").alias("size"), F.sum("taken").alias("taken"))
    d, h, size, taken, nth, words = (free_name(docs, c) for c in ("_d", "_h", "_size", "_taken", "_nth", "_words"))
    per = per.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), F.col("size").alias(size), F.col("taken").alias(taken))
    keyed = docs.withColumn(nth, F.xxhash64(text_col))
    one = (keyed.join(per, F.col(id_col).cast("long").eqNullSafe(F.col(d)) & (F.col(nth) == F.col(h)))
           .dropDuplicates([d, h]))
    copies = one.withColumn(nth, F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))))
    words_here = F.least(F.col(size), F.col(taken) - (F.col(nth) - 1) * F.col(size))
    copies = copies.withColumn(words, words_here.cast("int"))
    # up to the k-th word: drop what follows the k-th gap
    body = F.ltrim(F.col(text_col), F.lit(SPACE))
    rest = F.get(F.split(body, F.lit(r"[\x20\x09-\x0D]+"), F.col(words) + 1), F.col(words))
    head = F.substring(F.col(text_col), F.lit(1), F.length(text_col) - F.length(rest))
    cut = F.when(F.col(words) < F.col(size), F.rtrim(head, F.lit(SPACE))).otherwise(F.col(text_col))
    return copies.withColumn(text_col, cut).select(*[F.col(c) for c in docs.columns])


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents: size, their source's size and target, and the words that the mix takes."""
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")
