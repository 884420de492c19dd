"""Quality rules (10): counts per text and risk-controlled cutoffs, DataFrame functions only.

Words are runs of characters other than ``\\x20`` and ``\\x09-\\x0D``; a
window is three consecutive words.  Each rule rejects a text whose measure
lies above a cutoff.  Cutoffs are chosen per stratum (a column, such as the
language) from a fixed falling grid, on labelled holdout texts:

- At each grid point the good holdout texts that would be rejected are
  counted, x of n.  The exact binomial test rejects the hypothesis that the
  false rejection rate exceeds ``risk`` if P(Bin(n, risk) <= x) is at most
  the rule's level, which is the same as the Clopper-Pearson bound of x in n
  lying at or below ``risk``.
- Rules times strata share ``delta`` (Bonferroni); within a rule and stratum
  the points are tested from the laxest on and the walk ends at the first
  that fails, so all certified points hold at once with probability
  1 - ``delta``.
- Of the certified points the one with the best balance of rejected bad and
  rejected good texts is used, the laxest among equals.  A rule that gains
  nothing, or a stratum with too few labels, has no cutoff and rejects none.

Cases: null text counts as empty; a null stratum is the stratum of nulls;
texts without words have no measures and no rule rejects them (the base
rule does); repeated rows are counted and judged each for itself; labels of
unknown ids, null labels and labels other than 0 and 1 are ignored; without
labels only the base rule acts; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import written

RISK = 0.01
DELTA = 0.05
SPACE = " \t\n\x0b\f\r"
# rule -> (measure over the counted columns, laxest cutoff, factor to the next, number of points)
RULES = {
    "symbols": ("n_symbols / n_words", 4.0, 0.75, 20),
    "duplicate_lines": ("n_dup_lines / n_lines", 0.95, 0.85, 20),
    "repeated_words": ("n_repeat_words / n_words", 0.95, 0.85, 20),
    "word_length": ("word_chars / n_words", 60.0, 0.85, 15),
    "capitals": ("n_capitals / word_chars", 0.95, 0.85, 20),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def cutoffs(rule: str) -> list[float]:
    _, first, factor, points = RULES[rule]
    return [round(first * factor ** k, 6) for k in range(points)]


def _ratio(measure: str) -> Column:
    """``a / b`` of two counted columns, null where b is 0."""
    a, b = measure.split(" / ")
    return F.col(a) / F.when(F.col(b) != 0, F.col(b))


def _next(a: Column) -> Column:
    """The array without its first element."""
    return F.slice(a, 2, 1 << 30)


def _with_repeats(df: DataFrame, windows: str) -> DataFrame:
    """Adds n_repeat_words: words covered by windows whose hash occurs twice or more.

    Only texts with such a window sort their windows together with the
    places.  Each array is a column of its own, so that it is made once.
    """
    twice = F.size(F.array_distinct(windows)) < F.size(windows)
    df = df.withColumn("placed", F.when(twice, F.sort_array(
        F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    pairs = F.zip_with("placed", _next(F.col("placed")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("places", F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))))
    covered = F.zip_with("places", _next(F.col("places")), lambda p, q: F.least(F.lit(3), F.coalesce(q - p, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("placed", "places", windows)


def counted(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str | None = "lang") -> DataFrame:
    """(doc_id, stratum, and the columns of ``COUNTS``) per row."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"),
                       (F.col(stratum).cast("string") if stratum else F.lit(None).cast("string")).alias("stratum"),
                       t.alias("t"), F.trim(t, F.lit(SPACE)).alias("inner"))
    words = base.select("doc_id", "stratum", "t", F.when(F.col("inner") == "", F.array().cast("array<string>")).otherwise(
        F.split("inner", "[\\x20\\x09-\\x0D]+")).alias("w"))
    hashed = words.select("doc_id", "stratum", "t", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("hw"))
    two = F.zip_with("hw", _next(F.col("hw")), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with(two, _next(_next(F.col("hw"))), lambda a, b: F.xxhash64(a, b))
    windows = hashed.select("doc_id", "stratum", "t", "w", F.slice(three, 1, F.greatest(F.size("hw") - 2, F.lit(0))).alias("win"))
    lined = windows.select("doc_id", "stratum", "t", "w", "win",
                           F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "").alias("lines"))
    return _with_repeats(lined, "win").select(
        "doc_id", "stratum", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("t") - F.length(F.regexp_replace("t", "[A-Z]+", ""))).cast("long").alias("n_capitals"))


def at_most(x: Column, n: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= x) for x < n * risk, summed in logarithms; 1 for larger x."""
    start = n * F.lit(math.log1p(-risk))
    odds = F.lit(math.log(risk / (1 - risk)))

    def add(acc: Column, i: Column) -> Column:
        term = acc["l"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("l"), (acc["s"] + F.exp(term)).alias("s"))

    steps = F.when(x > 0, F.sequence(F.lit(1).cast("long"), F.greatest(x, F.lit(1)))).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(steps, F.struct(start.alias("l"), F.exp(start).alias("s")), add, lambda acc: acc["s"])
    return F.when(x < n * F.lit(risk), total).otherwise(F.lit(1.0))


def _first_exceeded(value: Column, grid: list[float]) -> Column:
    """Place of the first point of a falling grid that ``value`` exceeds; the number of points if none."""
    return F.size(F.filter(F.lit(grid), lambda c: ~F.coalesce(value > c, F.lit(False))))


def calibrated(measured: DataFrame, labels: DataFrame, *, label: str = "quality", risk: float = RISK,
               delta: float = DELTA) -> DataFrame:
    """(stratum, cuts): per stratum of the holdout a map rule -> cutoff."""
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)")
    points = []
    for rule, (measure, *_) in RULES.items():
        points.append(F.struct(F.lit(rule).alias("rule"), _first_exceeded(_ratio(measure), cutoffs(rule)).alias("k")))
    return _certified(_level_counts(measured, known, points), risk, delta)


def _level_counts(measured: DataFrame, known: DataFrame, points: list[Column]) -> DataFrame:
    """(stratum, rule, k, good, bad): holdout texts that a rule rejects from grid point k on."""
    return (measured.join(known, "doc_id").select("stratum", "y", F.explode(F.array(*points)).alias("p"))
            .groupBy("stratum", "p.rule", "p.k")
            .agg(F.sum(F.col("y")).alias("good"), F.sum(1 - F.col("y")).alias("bad")))


def _certified(levels: DataFrame, risk: float, delta: float) -> DataFrame:
    levels = written(levels, "levels")
    tests = max(1, levels.select("stratum").distinct().count()) * len(RULES)
    grid = F.create_map(*[x for rule in RULES for x in (F.lit(rule), F.lit(cutoffs(rule)))])
    totals = levels.groupBy("stratum", "rule").agg(F.sum("good").alias("n"), F.sum("bad").alias("n_bad"),
                                                   F.collect_list(F.struct("k", "good", "bad")).alias("at"))
    every = totals.select("stratum", "rule", "n", "n_bad", "at", F.posexplode(grid[F.col("rule")]).alias("k", "cut"))

    def below(field: str) -> Column:
        return F.aggregate("at", F.lit(0).cast("long"),
                           lambda acc, x: acc + F.when(x["k"] <= F.col("k"), x[field]).otherwise(F.lit(0)))

    tested = every.select("stratum", "rule", "n", "n_bad", "k", "cut", below("good").alias("x"), below("bad").alias("caught"))
    tested = tested.withColumn("p", at_most(F.col("x"), F.col("n"), risk))
    walk = Window.partitionBy("stratum", "rule").orderBy("k")
    sure = (tested.withColumn("worst", F.max("p").over(walk)).filter(F.col("worst") <= delta / tests)
            .withColumn("gain", F.col("caught") / F.greatest("n_bad", F.lit(1)) - F.col("x") / F.col("n"))
            .filter("gain > 0"))
    best = sure.groupBy("stratum", "rule").agg(F.max_by("cut", F.struct("gain", -F.col("k"))).alias("cut"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cuts"))


def judged(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
           stratum: str | None = "lang", label: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Counts, base_failed, rejected_by (rules) and kept per row."""
    measured = written(counted(docs, doc_id=doc_id, text=text, stratum=stratum), "measured")
    cuts = calibrated(measured, labels, label=label, risk=risk, delta=delta)
    joined = measured.join(cuts.withColumnRenamed("stratum", "s"), F.col("stratum").eqNullSafe(F.col("s")), "left")
    broken = [F.when(_ratio(measure) > F.col("cuts")[rule], F.lit(rule))
              for rule, (measure, *_) in RULES.items()]
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (joined.withColumn("base_failed", base).withColumn("rejected_by", F.array_compact(F.array(*broken)))
            .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
            .select("doc_id", "stratum", *COUNTS, "base_failed", "rejected_by", "kept"))
