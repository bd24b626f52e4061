"""Filter interaction audit: what each filter removes, alone and in every order of application.

Each document fails some of k filters, a mask of k bits. Per part, the documents and the labelled
good and toxic ones are counted by mask: at most 2^k rows a part, and all that follows needs no more.
A coalition S of filters removes v(S), the documents whose mask meets S. The removal game's
Hart-Mas-Colell potential is built up recursively over the 2^k coalitions, P(S) = (v(S) + the sum of
P(S without i) over i in S) / |S|, P of none = 0, held as k! * P, which is whole. A filter's Shapley
value is the grand potential minus the potential without that filter (times k!: its removals summed
over all k! orders). The steps of an order are differences of v between the coalitions before and after.

Texts are read once; what leaves the scan is one row of keys per document. Equal rows (same text,
part and id) are added up map-side before any shuffle. The duplicate filter compares each row's id
with its text's smallest: ids are spread before rows of one text meet, which are then one row per
part and label, so no text, however frequent, gathers its copies in a task.

Edge cases: null text counts as empty and equals empty text; a null part counts as the empty string;
a null id is neither smaller nor larger than any (such a row is no duplicate and makes none) and has
no label; of repeated rows with one id and text none is the other's duplicate; a document is good (or
toxic) if any label row of its id says 1; null labels say nothing; labels of unknown documents count
nowhere; other columns are not read; very long texts are read whole; an empty table gives no rows.
Texts are equal if their SHA-256 are.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajens.llm.common import SPACE, store, table

_MEASURES = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """The contract's filters that a text alone decides; words are ``[^\\x20\\x09-\\x0D]+``."""
    blank = F.btrim(F.translate(text, SPACE[1:], " " * (len(SPACE) - 1)))
    words = F.filter(F.split(blank, " "), lambda x: x != "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": counts["n"] < 200,
        "B": 100 * counts["d"] < 50 * counts["n"],
        "C": 100 * upper > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_of(failures: Mapping[str, Column], names: str) -> Column:
    """Bit i is set where the filter ``names[i]`` fails; names without a condition stay 0."""
    return sum((F.when(failures[f], F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(names) if f in failures), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column], names: str,
                   duplicate: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                   part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail. ``failures``: Boolean
    columns over ``docs``; ``duplicate`` names the filter that later copies of a text fail."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                        mask_of(failures, names).cast("int").alias("mask"), F.unhex(F.sha2(text, 256)).alias("key"))
            .groupBy("key", "part", "mask", "id").agg(F.count(F.lit(1)).alias("k")))
    rows = store(rows, "audit-rows")
    yes = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("boolean")
    marks = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
             .agg(yes("quality").alias("is_good"), yes("toxic").alias("is_toxic")))
    no = F.lit(False)
    known = (rows.where("id is not null").join(marks, "id", "left")
             .withColumns({c: F.coalesce(c, no) for c in ("is_good", "is_toxic")}))
    # rows without an id have no label: they stay out of the join, where they would be one key
    marked = known.unionByName(rows.where("id is null").withColumns({"is_good": no, "is_toxic": no}))
    # per text, part and labels: rows with an id, rows without, smallest id and how many rows have it
    same = marked.groupBy("key", "part", "mask", "is_good", "is_toxic").agg(
        F.sum(F.when(F.col("id").isNotNull(), F.col("k")).otherwise(0)).alias("k"),
        F.sum(F.when(F.col("id").isNull(), F.col("k")).otherwise(0)).alias("anonymous"),
        F.min("id").alias("least"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "k")))["k"].alias("firsts"))
    bit = 1 << names.index(duplicate) if duplicate else 0
    if bit:
        # a text's rows here: its parts x four label pairs
        first = F.min("least").over(Window.partitionBy("key"))
        late = F.col("k") - F.when(F.col("least") == F.col("_first"), F.col("firsts")).otherwise(0)
        same = same.withColumn("_first", first).withColumn("late", F.when(F.col("k") > 0, late).otherwise(0))
    else:
        same = same.withColumn("late", F.lit(0))
    kinds = F.array(F.struct(F.col("mask").alias("mask"), (F.col("k") - F.col("late") + F.col("anonymous")).alias("n")),
                    F.struct((F.col("mask") + bit).alias("mask"), F.col("late").alias("n")))
    flat = same.select("part", "is_good", "is_toxic", F.explode(kinds).alias("x"))
    return flat.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.when(F.col("is_good"), F.col("x.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("is_toxic"), F.col("x.n")).otherwise(0)).alias("toxic"))


def coalition_games(counts: DataFrame, k: int) -> DataFrame:
    """One row per part: ``total``; arrays over the 2^k coalitions ``v_n``, ``v_good``, ``v_toxic``
    (what each removes) and ``potential`` (k! times the removal game's potential)."""
    size = 1 << k
    spread = [F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(size)]).alias(c) for c in _MEASURES]
    per_part = counts.groupBy("part").agg(F.sum("n").alias("total"), *spread)
    masks = F.sequence(F.lit(0), F.lit(size - 1))

    def removed(c: str) -> Column:
        meets = lambda s: F.aggregate(masks, F.lit(0).cast("long"), lambda a, m: a + F.when(m.bitwiseAND(s) != 0, F.get(c, m)).otherwise(0))
        return F.transform(masks, meets).alias(f"v_{c}")

    def next_potential(p: Column, s: Column) -> Column:
        without = sum((F.when(s.bitwiseAND(1 << i) != 0, F.get(p, s - (1 << i))).otherwise(0) for i in range(k)), F.lit(0))
        value = (F.lit(factorial(k)) * F.get("v_n", s) + without) / F.bit_count(s)
        return F.concat(p, F.array(F.round(value).cast("long")))  # whole: |S|! divides k!

    games = per_part.select("part", "total", *[removed(c) for c in _MEASURES])
    none = F.array(F.lit(0).cast("long"))
    return games.withColumn("potential", F.aggregate(F.sequence(F.lit(1), F.lit(size - 1)), none, next_potential))


def order_steps(games: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step: see ``op12_filter_audit`` for the columns."""
    k = len(names)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(names)])
    places = F.sequence(F.lit(1), F.lit(k))
    bit_at = lambda x: F.pow(F.lit(2), F.instr(F.lit(names), F.substr("filter_order", x, F.lit(1))) - 1).cast("int")
    steps = (games.select("*", F.explode(orders).alias("filter_order"))
             .select("*", F.explode(places).alias("step"))
             .withColumn("_bit", bit_at(F.col("step")))
             .withColumn("_before", F.aggregate(F.filter(places, lambda x: x < F.col("step")), F.lit(0), lambda a, x: a + bit_at(x))))
    before, after, own, rest = (F.col("_before"), F.col("_before") + F.col("_bit"), F.col("_bit"), F.lit((1 << k) - 1) - F.col("_bit"))
    at = lambda c, s: F.get(c, s)
    lost = lambda c: at(c, after) - at(c, before)
    whole = F.lit((1 << k) - 1)
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - at("v_n", after)).alias("kept"), lost("v_n").alias("removed"),
        (at("v_n", own) - lost("v_n")).alias("redundant"), (at("v_n", whole) - at("v_n", rest)).alias("unique_fails"),
        lost("v_good").alias("good_lost"), lost("v_toxic").alias("toxic_lost"),
        (at("potential", whole) - at("potential", rest)).alias("shapley"))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All documents by language: filters A to D on the text, E for later copies, every order and step.
    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley are document counts."""
    docs, names = table(spark, sf_dir, "documents"), "ABCDE"
    counts = failure_counts(docs, table(spark, sf_dir, "labels"), text_failures(F.coalesce("text", F.lit(""))), names, duplicate="E")
    return order_steps(coalition_games(store(counts, "audit-counts"), len(names)), names)


#: the same table from each document's failures and each order in turn, without coalitions
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
          100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
          coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
h AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
c AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, x.i, y.i, z.i] AS p FROM c a, c b, c x, c y, c z WHERE len(list_distinct([a.i, b.i, x.i, y.i, z.i])) = 5),
s AS (
  SELECT array_to_string(list_transform(p, lambda i: chr(CAST(64 + i AS INTEGER))), '') AS filter_order, p,
         c.i AS step, p[c.i] AS own, p[1:c.i - 1] AS before FROM o, c),
r AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS failing,
         len(list_filter(before, lambda i: fails[i])) > 0 AS gone,
         len(list_filter(fails, lambda x: x)) = 1 AND fails[own] AS only_here FROM h, s),
t AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN only_here THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND failing AND good THEN n ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT gone AND failing AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM t
"""
