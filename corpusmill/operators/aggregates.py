"""Counts, rates, confusion matrices, significance, weighted means.

Everything is a sum, count, minimum or maximum that combines before its shuffle.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import pinned

INVALID = "INVALID"


def label_table(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, ord int")


def count_labels(df: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """A1: zero-filled, in the order of the domain."""
    c = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return label_table(df, labels).join(c, "label", "left").select("label", "ord", F.coalesce("n", F.lit(0)).alias("n"))


def count_reasons(df: DataFrame, reason: str) -> DataFrame:
    """A2"""
    return df.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def length_stats(df: DataFrame, c: Column, by: list[str] | None = None) -> DataFrame:
    """Min, max and mean (half-even to 2 places) of a length; zeros for no rows."""
    n = F.length(c)
    return df.groupBy(*(by or [])).agg(F.coalesce(F.min(n), F.lit(0)).cast("long").alias("min_length"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_length"), F.coalesce(F.bround(F.avg(n), 2), F.lit(0.0)).alias("mean_length"))


def count_by_letter(df: DataFrame, letter: str, letters: list[str]) -> DataFrame:
    """A4: one row with a count per letter."""
    return df.agg(*[F.count_if(F.col(letter) == x).alias(f"n_{x}") for x in letters])


def rates(df: DataFrame, flags: list[str], by: list[str] | None = None) -> DataFrame:
    """N and the share of each flag; nulls count as false, no rows give 0."""
    share = lambda f: F.coalesce(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("double")), F.lit(0.0)).alias(f"{f}_rate")
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *map(share, flags))


def confusion(df: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """Every (truth, predicted) of the domain with its count; predictions outside are INVALID."""
    p = F.when(F.col(predicted).isin(*labels), F.col(predicted)).otherwise(INVALID)
    c = df.groupBy(F.col(truth).alias("truth"), p.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame([(t, q) for t in labels for q in [*labels, INVALID]], "truth string, predicted string")
    return grid.join(c, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class of a confusion matrix; 0 where a denominator is."""
    own = F.col("truth") == F.col("predicted")
    rows = matrix.groupBy(F.col("truth").alias("label")).agg(F.sum(F.when(own, F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("actual"))
    cols = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    d = rows.join(cols, "label", "left")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp = F.col("tp").cast("double")
    return d.select("label", ratio(tp, F.col("called")).alias("precision"), ratio(tp, F.col("actual")).alias("recall"), ratio(2 * tp, F.col("called") + F.col("actual")).alias("f1"))


def macro_f1(matrix: DataFrame) -> DataFrame:
    return class_scores(matrix).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def predicted_distribution(df: DataFrame, predicted: str) -> DataFrame:
    """A9"""
    return df.groupBy(F.coalesce(predicted, F.lit(INVALID)).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def collapse(df: DataFrame, predicted: str, near: float = 0.9) -> DataFrame:
    """A10: the most frequent prediction, its share, and none, near or total; no row for no predictions."""
    d = predicted_distribution(df, predicted)
    t = d.agg(F.sum("n").alias("total"), F.max_by("label", F.struct("n", "label")).alias("label"), F.max("n").alias("n")).where("total > 0")
    share = F.col("n") / F.col("total")
    return t.select("label", share.alias("share"), F.when(F.col("n") == F.col("total"), "total").when(share >= near, "near").otherwise("none").alias("collapse"))


def chance_band(n: Column, classes: int, z: float = 1.96) -> Column:
    """struct(expected, low, high) of random accuracy over n balanced rows; high is the threshold to beat."""
    p = 1.0 / classes
    half = z * F.sqrt(p * (1 - p) / n)
    return F.struct(F.lit(p).alias("expected"), (p - half).alias("low"), (p + half).alias("high"))


def binomial_p(a_only: int, b_only: int) -> float:
    """Exact two-sided p of a split of disagreements.

    Up to 1000 of them it is a quotient of whole numbers.  From there on the tail is added up from its
    largest term down until terms no longer count, some multiple of sqrt(n) of them."""
    n, k = a_only + b_only, min(a_only, b_only)
    if not n:
        return 1.0
    if n <= 1000:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    total, term, i = 0.0, 1.0, k
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i / (n - i + 1)
        i -= 1
    largest = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    return min(1.0, 2 * total * math.exp(largest))


@F.pandas_udf(T.DoubleType())
def _exact_p(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([binomial_p(int(x or 0), int(y or 0)) for x, y in zip(a, b, strict=True)])


def mcnemar(pairs: DataFrame, a_right: str, b_right: str, by: list[str] | None = None) -> DataFrame:
    """a_only, b_only and the exact p of paired verdicts; p is 1 without disagreement."""
    a, b = (F.coalesce(F.col(c), F.lit(False)) for c in (a_right, b_right))
    d = pairs.groupBy(*(by or [])).agg(F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"))
    return d.withColumn("p", _exact_p("a_only", "b_only"))


def transitions(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Counts of right and wrong before and after, zero-filled."""
    a, b = (F.coalesce(F.col(c), F.lit(False)) for c in (before, after))
    return pairs.agg(F.count_if(~a & b).alias("wrong_to_right"), F.count_if(a & ~b).alias("right_to_wrong"), F.count_if(a & b).alias("right_to_right"), F.count_if(~a & ~b).alias("wrong_to_wrong"))


def weighted_mean(df: DataFrame, total: str, count: str, by: list[str] | None = None) -> DataFrame:
    """Sum of losses over sum of tokens; 0 for no tokens."""
    return df.groupBy(*(by or [])).agg(F.coalesce(F.try_divide(F.sum(F.col(total).cast("double")), F.sum(count)), F.lit(0.0)).alias("mean_loss"))


def masked_moments(df: DataFrame, value: str, mask: str) -> DataFrame:
    """Mean and variance where the mask is 1; the count is at least 1."""
    n = F.greatest(F.sum(mask), F.lit(1))
    mean = F.sum(F.col(value) * F.col(mask)) / n
    square = F.sum(F.col(value) * F.col(value) * F.col(mask)) / n
    return df.agg(mean.alias("mean"), F.greatest(square - mean * mean * (2 - F.sum(mask) / n), F.lit(0.0)).alias("variance"))


def whiten(df: DataFrame, value: str, mask: str, name: str = "whitened", epsilon: float = 1e-8) -> DataFrame:
    """(value - mean) / sqrt(variance + epsilon) under the mask, 0 outside it."""
    m = masked_moments(df, value, mask).select(F.col("mean").alias("_m"), F.col("variance").alias("_v"))
    return df.join(F.broadcast(m)).withColumn(name, F.when(F.col(mask) == 0, 0.0).otherwise((F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + epsilon) * F.col(mask))).drop("_m", "_v")


#: Bins into which a pass of median() divides what is left of a group's range, and rows of a range that are few enough to sort.
MEDIAN_BINS, MEDIAN_FEW = 1024, 10_000


def _median_bin() -> Column:
    """The bin of _v within lo..hi: by sign where the range has both, by logarithm where it is wide, else in equal parts.
    The ends have bins of their own, so each pass leaves less."""
    v, lo, hi = F.col("_v"), F.col("lo"), F.col("hi")
    near = lambda c: F.greatest(F.least(c, F.lit(8e307)), F.lit(-8e307))
    share = lambda f: F.try_divide(near(f(v)) / 2 - near(f(lo)) / 2, near(f(hi)) / 2 - near(f(lo)) / 2)
    part = F.when((lo > 0) & (hi / 4 > lo), share(F.log)).when((hi < 0) & (lo / 4 < hi), share(lambda x: -F.log(-x))).otherwise(share(lambda x: x))
    inner = F.least(F.greatest(F.floor(F.coalesce(part, F.lit(0.0)) * MEDIAN_BINS), F.lit(0)), F.lit(MEDIAN_BINS - 1)) + 1
    sign = F.when(v < 0, 1).when(v == 0, 2).otherwise(3)
    return F.when(v == lo, 0).when(v == hi, MEDIAN_BINS + 1).when((lo < 0) & (hi > 0), sign).otherwise(inner)


def median(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Exact, the mean of both middle values where a group has an even number; NaN is above all numbers.

    A pass counts each group's rows in bins of the range in which the middle lies, with each bin's least and greatest
    value, and the bin that holds it is the next range; bins combine before the shuffle, so no task sees a
    group's values.  Ranges shrink to values that occur until one is left or few rows are, which are sorted.  Groups
    without values are null."""
    by = by or []
    d = pinned(df.select(*by, F.col(value).cast("double").alias("_v")))
    same = lambda x, y: reduce(and_, [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in by], F.lit(True))
    keys = lambda x: [F.col(f"{x}.{c}").alias(c) for c in by]
    groups = d.groupBy(*by).agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    state = pinned(groups.withColumns({"below": F.lit(0).cast("long"), "inside": F.col("n")}))
    middle = F.floor((F.col("n") - 1) / 2)
    open_ = (F.col("lo") < F.col("hi")) & (F.col("inside") > MEDIAN_FEW)
    while not (wide := state.where(open_)).isEmpty():
        x = d.alias("d").join(wide.alias("s"), same("d", "s")).where(F.col("_v").between(F.col("lo"), F.col("hi")))
        bins = x.select(*keys("d"), "n", "below", _median_bin().alias("bin"), "_v").groupBy(*by, "n", "below", "bin").agg(F.count(F.lit(1)).alias("inside"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = F.coalesce(F.sum("inside").over(W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # MEDIAN_BINS + 2 rows a group at most
        bins = bins.withColumn("below", F.col("below") + before).where((F.col("below") <= middle) & (middle < F.col("below") + F.col("inside")))
        state = pinned(bins.select(*by, "n", "lo", "hi", "below", "inside").unionByName(state.where(~F.coalesce(open_, F.lit(False)))))
    left = d.alias("d").join(state.alias("s"), same("d", "s")).where((F.col("_v") >= F.col("lo")) & ((F.col("lo") < F.col("hi")) | (F.col("_v") > F.col("hi"))))
    few = F.array_sort(F.collect_list(F.when(F.col("_v") <= F.col("hi"), F.col("_v"))))  # MEDIAN_FEW values at most
    rest = left.groupBy(*keys("d")).agg(few.alias("few"), F.min(F.when(F.col("_v") > F.col("hi"), F.col("_v"))).alias("next"))
    place = (middle - F.col("below")).cast("int")
    at = lambda i: F.when(i >= F.col("inside"), F.col("next")).otherwise(F.when(F.col("lo") < F.col("hi"), F.get("few", i)).otherwise(F.col("lo")))
    lower = F.when(F.col("n") > 0, at(place))
    out = state.alias("s").join(rest.alias("r"), same("s", "r"), "left")
    return out.select(*keys("s"), F.when(F.col("n") % 2 == 0, lower / 2 + at(place + 1) / 2).otherwise(lower).alias("median"))


def distinct_check(df: DataFrame, key: str) -> DataFrame:
    """Rows, different keys, and whether they agree."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("n_distinct")).withColumn("unique", F.col("n") == F.col("n_distinct"))


def max_by_split(df: DataFrame, value: str, split: str) -> DataFrame:
    """A20"""
    return df.groupBy(split).agg(F.max(value).alias("max_value"))
