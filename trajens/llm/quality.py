"""Quality rules with risk-controlled thresholds.

A rule rejects a document when a measure of its text exceeds a cutoff. Cutoffs are chosen per rule
and stratum (length band) on the labelled documents: a cutoff is certified when the exact binomial
(Clopper-Pearson) upper bound on the share of good documents it rejects is at most ``alpha``.
Testing walks from the loosest cutoff of the grid to the tightest and stops at the first that
fails (fixed-sequence test, no price for the grid); the error ``delta`` is split evenly over all
(rule, stratum) walks (Bonferroni). So with probability 1 - delta no chosen cutoff wrongly rejects
more than ``alpha`` of any stratum. Among the certified ones the cutoff with most rejected bad
documents, less ``price`` times the share of good ones, is used; ties go to the loosest. Where
nothing is certified (few labels) the rule rejects nothing in that stratum.

The bound needs no inverse: its upper end is at most alpha exactly when
P(Binomial(n, alpha) <= k) <= delta', so per stratum the largest such k is found by summing the
binomial terms in logarithms, an ``aggregate`` over at most alpha * n terms.

Everything is DataFrame expressions. Texts are read once and never shuffled; the measures (a few
numbers per document) are written to the shared folder and joined with the labels there.
Five-word windows are compared by their 64-bit hashes within one document.

Edge cases: null, empty or blank text has no words and fails the base rule; a label counts as good
only if all labels of its document are 1, null labels count for nothing; labels of unknown
documents and null ids match nothing; repeated rows each keep their row, but count once (by their least
measures) where cutoffs are chosen; other columns are not
read; empty tables give an empty result or no thresholds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajens.llm.common import SPACE, store, table

_GAP = r"[\x20\x09-\x0D]+"
#: measure -> numerator and denominator columns
RULES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
}


@dataclass(frozen=True)
class Risk:
    """Parameters of the threshold choice."""

    alpha: float = 0.01
    delta: float = 0.05
    price: float = 5.0
    bands: tuple = (50, 200, 1000)
    grid: tuple = field(default_factory=lambda: tuple(round(0.95 - 0.025 * i, 3) for i in range(38)))


def _covered(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more: sort (hash, place), keep places
    with an equal neighbour, then add up min(5, gap to the next kept place)."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def total(p: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(p, start, step, lambda a: a["n"])

    # one-element arrays bind the sorted pairs and places once, for use inside the lambdas
    places = F.transform(F.array(pairs), twice)
    return F.transform(places, total)[0]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words), longs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
                       F.btrim(text, F.lit(SPACE)).alias("core"))
    words = F.when(F.col("core") == "", F.array().cast("array<string>")).otherwise(F.split("core", _GAP))
    solid = F.regexp_replace("text", _GAP, "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    one = base.select("doc_id", words.alias("words"), solid.alias("solid"), lines.alias("lines"))
    at = lambda i, k: F.get("words", i + k)
    windows = F.transform(F.sequence(F.lit(0), F.size("words") - 5),
                          lambda i: F.xxhash64(*[at(i, k) for k in range(5)]))
    two = one.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.length("solid").cast("long").alias("word_chars"),
        (F.length("solid") - F.length(F.regexp_replace("solid", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 5, windows).alias("windows"))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    return two.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines",
                      F.when(some, _covered(F.col("windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def share(rule: str) -> Column:
    top, bottom = RULES[rule]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def stratum(bands) -> Column:
    """Length band: number of band limits that the word count reaches."""
    return sum((F.col("n_words") >= b).cast("int") for b in bands)


def most_allowed(n: Column, alpha: float, level: float) -> Column:
    """Largest k with P(Binomial(n, alpha) <= k) <= level, -1 if none: rejecting at most k of n
    good documents keeps the exact upper confidence bound at or below alpha."""
    odds = math.log(alpha) - math.log1p(-alpha)
    m = n.cast("double")
    start = F.struct((m * math.log1p(-alpha)).alias("p"), F.lit(-1e300).alias("c"), F.lit(-1).alias("k"))

    def step(a, i):
        p = F.when(i == 0, a["p"]).otherwise(a["p"] + F.log((m - i + 1) / i) + odds)
        c = F.greatest(a["c"], p) + F.log1p(F.exp(-F.abs(a["c"] - p)))
        return F.struct(p.alias("p"), c.alias("c"), F.when(c <= math.log(level), i).otherwise(a["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(0), F.floor(m * alpha).cast("int")), start, step, lambda a: a["k"])


def thresholds(measured: DataFrame, labels: DataFrame, risk: Risk = Risk(), id_col: str = "doc_id",
               label_col: str = "quality") -> DataFrame:
    """(stratum, rule, cutoff): one row per stratum and rule for which a cutoff is certified.
    ``measured``: output of ``measures``; ``labels``: (id, 0/1)."""
    marks = (labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
             .agg(F.min(label_col).cast("int").alias("good")))
    # one row per labelled id: a document's repeated rows are no further trials
    own = [c for c in measured.columns if c != "doc_id"]
    once = measured.join(marks, "doc_id").groupBy("doc_id", "good").agg(F.min(F.struct(*own)).alias("m")).select("good", "m.*")
    held = (once.where("n_words >= 10")
            .select(stratum(risk.bands).alias("stratum"), "good",
                    F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), share(r).alias("v")) for r in RULES])).alias("x")))
    # per label, the number of grid steps its value exceeds; counts per step are one small table
    steps = F.array(*[F.lit(float(g)) for g in risk.grid])
    passed = F.size(F.filter(steps, lambda g: g >= F.col("x.v")))
    counted = (held.select("stratum", "x.rule", "good", passed.alias("step"))
               .groupBy("stratum", "rule", "step").agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b")))
    all_steps = (counted.groupBy("stratum", "rule").agg(F.sum("g").alias("n_good"), F.sum("b").alias("n_bad"))
                 .select("*", F.posexplode(steps).alias("step", "cutoff")))
    # rejected at cutoff number s: values whose step count is at most s
    reached = (all_steps.join(counted.select("stratum", "rule", F.col("step").alias("at"), "g", "b"), ["stratum", "rule"])
               .groupBy("stratum", "rule", "step", "cutoff", "n_good", "n_bad")
               .agg(F.sum(F.when(F.col("at") <= F.col("step"), F.col("g")).otherwise(0)).alias("bad_calls"),
                    F.sum(F.when(F.col("at") <= F.col("step"), F.col("b")).otherwise(0)).alias("caught")))
    level = risk.delta / (len(RULES) * (len(risk.bands) + 1))
    tested = reached.withColumn("ok", F.col("bad_calls") <= most_allowed(F.col("n_good"), risk.alpha, level))
    walk = Window.partitionBy("stratum", "rule").orderBy("step")  # one row per grid step
    gain = (F.col("caught") / F.greatest(F.col("n_bad"), F.lit(1))
            - risk.price * F.col("bad_calls") / F.greatest(F.col("n_good"), F.lit(1)))
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), "step")
    return (tested.withColumn("walked", F.min(F.col("ok").cast("int")).over(walk)).where("walked = 1")
            .withColumn("gain", gain).withColumn("nth", F.row_number().over(best)).where("nth = 1")
            .select("stratum", "rule", "cutoff"))


def quality(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), id_col: str = "doc_id",
            text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, measures, base_failed, stratum, rejected_by, kept), one row per input row."""
    m = store(measures(docs, id_col, text_col), "quality-measures")
    cuts = thresholds(m, labels, risk, id_col, label_col)
    # at most one row per stratum: a few numbers
    rules = cuts.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = m.withColumn("base_failed", base).withColumn("stratum", stratum(risk.bands))
    broken = F.array_compact(F.array(*[F.when(share(r) > F.col("cuts")[r], F.lit(r)) for r in RULES]))
    none = F.array().cast("array<string>")
    return (judged.join(F.broadcast(rules), "stratum", "left")
            .withColumn("rejected_by", F.when(F.col("cuts").isNull(), none).otherwise(broken)).drop("cuts")
            .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """All documents, thresholds from the ``quality`` labels."""
    q = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "n_lines", "stratum", F.array_join("rejected_by", ",").alias("rejected_by"))
