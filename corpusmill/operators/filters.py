"""Filters that say why: reason columns, funnels, examples, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import distinct2, norm_space, strip, text


def hard_quality(answer: Column | str, least: int = 30, judged_from: int = 50, ratio: float = 0.45) -> Column:
    """long enough, and varied where it is long enough to tell."""
    a = text(answer)
    return (F.length(a) >= least) & ((F.length(a) < judged_from) | (distinct2(a) >= ratio))


def within_budget(tokens: Column, budget: int) -> Column:
    """over-long rows are rejected, never cut."""
    return tokens <= budget


def budget_with_longest(df: DataFrame, tokens: str, targets: DataFrame, target_tokens: str, budget: int) -> DataFrame:
    """rows that fit with the longest target, whichever is theirs."""
    longest = targets.agg(F.max(target_tokens).alias("_longest"))
    return df.join(F.broadcast(longest)).where(F.col(tokens) + F.coalesce("_longest", F.lit(0)) <= budget).drop("_longest")


def long_enough(c: Column | str, least: int) -> Column:
    """by characters that are no white space."""
    return F.length(norm_space(c)) >= least


def valid_letter(c: Column | str) -> Column:
    """F6"""
    return F.upper(strip(c)).rlike("^[A-E]$")


def options_hold(options: Column, answer: Column, least: int = 2, most: int = 5) -> Column:
    """F7"""
    return F.coalesce(F.size(options).between(least, most) & F.map_contains_key(options, F.upper(strip(answer))), F.lit(False))


def needs_image(c: Column | str) -> Column:
    """F8"""
    return F.contains(text(c), F.lit("图"))


def fits_evaluation(question: Column | str, options: Column, most_question: int = 100, most_option: int = 80) -> Column:
    """F9"""
    return F.length(strip(question)).between(1, most_question) & F.forall(F.map_values(options), lambda v: F.length(strip(v)).between(1, most_option))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """the first rule that a row fails; null if it fails none.  Rules are (reason, failed)."""
    out = None
    for reason, failed in rules:
        out = F.when(failed, reason) if out is None else out.when(failed, reason)
    return out if out is not None else F.lit(None).cast("string")


def explained(explanation: Column | str, least: int = 10) -> Column:
    """F16"""
    return F.length(strip(explanation)) >= least


def closed_domain(df: DataFrame, label: str, domain: dict[str, str], strict: bool = False) -> DataFrame:
    """labels mapped to their domain; rows outside go, or are an error where strict."""
    keys = F.create_map(*[F.lit(x) for kv in domain.items() for x in kv])
    d = df.withColumn(label, F.try_element_at(keys, strip(label)))
    if strict:
        return d.withColumn(label, F.when(F.col(label).isNull(), F.raise_error(F.lit("label outside its domain"))).otherwise(F.col(label)))
    return d.where(F.col(label).isNotNull())


def passed_review(df: DataFrame, key: str, verdicts: DataFrame, wanted: str = "no_obvious_issue") -> DataFrame:
    """rows whose latest verdict is the wanted one; rows without one are pending and go."""
    v = verdicts.select(F.col(key), F.col("verdict").alias("_verdict"))
    return df.join(v, key, "left").where(F.coalesce("_verdict", F.lit("pending")) == wanted).drop("_verdict")


def funnel(df: DataFrame, reason: str, order: list[str]) -> DataFrame:
    """stage, reason, dropped, survivors, for the reasons in order; the last row has what passes.

    The rows are counted once, with partial counts; the running sum is over the reasons."""
    ord_ = F.coalesce(*[F.when(F.col("reason") == r, F.lit(i)) for i, r in enumerate(order)], F.lit(len(order)))
    counts = df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).count()
    spine = df.sparkSession.createDataFrame([(r,) for r in [*order, "kept"]], "reason string")
    c = spine.join(counts, "reason", "left").select(ord_.cast("long").alias("stage"), "reason", F.coalesce("count", F.lit(0)).alias("dropped"))
    total = F.sum("dropped").over(W.partitionBy(F.lit(0)))
    before = F.sum("dropped").over(W.partitionBy(F.lit(0)).orderBy("stage"))
    return c.select("stage", "reason", "dropped", F.when(F.col("reason") == "kept", F.col("dropped")).otherwise(total - before).alias("survivors"))


def examples(df: DataFrame, reason: str, order: str, most: int = 10) -> DataFrame:
    """the first rejected rows of each reason."""
    w = W.partitionBy(reason).orderBy(order)
    return df.where(F.col(reason).isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def numbered(df: DataFrame, order: list[str], prefix: str, name: str = "id", width: int = 5) -> DataFrame:
    """sequential ids such as train_00001 in the order of columns."""
    from ..sources.io import with_row_id

    return with_row_id(df, order, "_row").withColumn(name, F.format_string(f"{prefix}_%0{width}d", F.col("_row") + 1)).drop("_row")
