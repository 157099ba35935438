"""Reproducible order, samples, refills, top-k.

Draws are by md5 of a seed and the key, which any engine gives alike and any rerun again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import pinned, with_row_id
from .windows import ranked


def draw(key: Column | str, seed: int | str) -> Column:
    """The sort key of a seeded shuffle."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")).cast("binary"))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with their place in the shuffle, from 0."""
    return with_row_id(df.withColumn("_draw", draw(key, seed)), ["_draw", key], "position").drop("_draw")


def sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """T4: k rows; fewer only if there are fewer.  A top-k, so tasks send k rows each."""
    return df.withColumn("_draw", draw(key, seed)).orderBy("_draw", key).limit(k).drop("_draw")


def sample_per_group(df: DataFrame, group: str, key: str, k: int, seed: int) -> DataFrame:
    """T5: k rows of each group."""
    return ranked(df.withColumn("_draw", draw(key, seed)), group, ["_draw", key], "_rank").where(F.col("_rank") <= k).drop("_draw", "_rank")


def drop_bottom(df: DataFrame, score: str, tie: str, share: float) -> DataFrame:
    """Without the int(n share) rows of least (score, tie); rows that tie on both with the first kept stay.

    Only the two columns are sorted; rows are then compared with the one at the cut."""
    d = pinned(df)  # the score may be costly, and the order is found in three passes
    cut = int(d.count() * share)
    bound = with_row_id(d.select(score, tie), [score, tie], "_row").where(F.col("_row") == cut).select(F.struct(score, tie).alias("_bound"))
    return d.join(F.broadcast(bound), F.struct(score, tie) >= F.col("_bound")).drop("_bound")  # one row


def refill(kept: DataFrame, pool: DataFrame, key: str, want: int) -> DataFrame:
    """Kept members, then pool members by ascending key, up to want of both."""
    fresh = pool.join(kept.select(key), key, "left_anti")
    both = kept.withColumn("_prio", F.lit(0)).unionByName(fresh.withColumn("_prio", F.lit(1)))
    return both.orderBy("_prio", key).limit(want).drop("_prio")


def first_survivors(df: DataFrame, order: str, most: int) -> DataFrame:
    """The first rows in order; statistics of a scan that stops stop at the last of them."""
    return df.orderBy(order).limit(most)


def arg_best(df: DataFrame, group: str, label: str, score: str, domain: list[str], least: bool = False) -> DataFrame:
    """The label of greatest (or least) score; the first of the domain wins ties."""
    ord_ = F.coalesce(*[F.when(F.col(label) == x, F.lit(i)) for i, x in enumerate(domain)], F.lit(len(domain)))
    s = F.col(score) if least else -F.col(score)
    return df.groupBy(group).agg(F.min_by(label, F.struct(s, ord_)).alias("best"))


def top_reasons(df: DataFrame, reason: str, most: int = 10) -> DataFrame:
    """T13"""
    c = df.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), "reason").limit(most)


def require_rows(df: DataFrame, want: int) -> DataFrame:
    """An error if there are fewer than want rows; never padded by copies."""
    n = df.count()
    if n < want:
        raise ValueError(f"{want} rows wanted, {n} there")
    return df


def batches(df: DataFrame, key: str, seed: int, epoch: int, size: int, skip: int = 0) -> DataFrame:
    """Shuffled per epoch, with batch numbers; the first skip batches are left out on resuming."""
    d = shuffled(df, key, f"{seed}:{epoch}")
    return d.withColumn("batch", F.floor(F.col("position") / size).cast("long")).where(F.col("batch") >= skip)
