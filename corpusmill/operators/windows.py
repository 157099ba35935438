"""Order-dependent forms: interleaving, nested prefixes, cursor splits, curves, advantages.

Windows that rank by hash within a label need a label's rows together.  Where a label may have
a third of all rows, ``ranked`` takes range partitions instead: each knows its rows'
places within it, and the offsets are counts per partition and label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.io import pinned


def ranked(df: DataFrame, label: str, order: list[str], name: str = "rank") -> DataFrame:
    """Places from 1 within each label, in the order of columns, without a task per label.

    Rows are dealt by range of (label, order); a place is the number of the label's rows in
    earlier partitions plus the place within its own."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, label, *order).withColumn("_part", F.spark_partition_id())
    w = W.partitionBy("_part", label).orderBy(*order)
    d = pinned(d.withColumn("_place", F.row_number().over(w)))
    sizes = d.groupBy("_part", label).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(label).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    b = before.select(F.col("_part").alias("_p"), F.col(label).alias("_l"), "_before")
    out = d.join(b, (F.col("_part") == F.col("_p")) & F.col(label).eqNullSafe(F.col("_l")))
    return out.withColumn(name, F.col("_place") + F.col("_before")).drop("_part", "_place", "_p", "_l", "_before")


def round_robin(df: DataFrame, label: str, order: list[str], labels: list[str]) -> DataFrame:
    """Position from 0 such that each run of len(labels) rows has every label once; an error unless the
    classes are equal."""
    ord_ = F.coalesce(*[F.when(F.col(label) == x, F.lit(i)) for i, x in enumerate(labels)])
    sizes = df.groupBy(F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.max("n"), F.count(F.lit(1)), F.count_if(~F.coalesce(F.col("l").isin(*labels), F.lit(False)))).first()
    if sizes[2] and (sizes[0] != sizes[1] or sizes[2] != len(labels) or sizes[3]):
        raise ValueError(f"classes are not equal: {sizes[2]} of {len(labels)} labels, {sizes[3]} unknown, from {sizes[0]} to {sizes[1]} rows")
    return ranked(df, label, order, "_rank").withColumn("position", (F.col("_rank") - 1) * len(labels) + ord_).drop("_rank")


def nested_prefixes(df: DataFrame, position: str, sizes: list[int], labels: int) -> DataFrame:
    """(size, row) for each prefix; a size must be a multiple of the labels' number."""
    if any(s % labels for s in sizes):
        raise ValueError("a prefix must hold whole rounds of labels")
    return df.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where(F.col(position) < F.col("size"))


def cursor_split(df: DataFrame, label: str, order: list[str], sizes: list[tuple[str, int]]) -> DataFrame:
    """Consecutive slices of each label, in the order given; rows beyond them go."""
    d, at, split = ranked(df, label, order, "_rank"), 0, None
    for name, n in sizes:
        inside = (F.col("_rank") > at) & (F.col("_rank") <= at + n)
        split = F.when(inside, name) if split is None else split.when(inside, name)
        at += n
    return d.withColumn("split", split).where("split IS NOT NULL").drop("_rank")


def share_sizes(wanted: list[tuple[str, int]], labels: int) -> list[tuple[str, int]]:
    """Rows per label for cursor_split(): the first split's total divided upwards, later ones' downwards, at least one."""
    return [(name, max(1, -(-n // labels) if i == 0 else n // labels)) for i, (name, n) in enumerate(wanted)]


def adjacent(points: DataFrame, size: str, value: str, curve: str | None = None) -> DataFrame:
    """Each point with the next larger one of its curve; a curve is a few aggregated points."""
    w = W.partitionBy(curve if curve else F.lit(0)).orderBy(size)
    return points.withColumn("next_size", F.lead(size).over(w)).withColumn("next_value", F.lead(value).over(w)).where("next_size IS NOT NULL")


def running_best(df: DataFrame, step: str, loss: str, run: str | None = None) -> DataFrame:
    """is_best where the loss is strictly under all before it.

    Rows are dealt by range of (run, step); what a run's earlier partitions had as their least
    loss is one row each, so a run with a third of all rows is no hot task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("_run", F.col(run) if run else F.lit(0))
    d = pinned(d.repartitionByRange(n, "_run", step).withColumn("_part", F.spark_partition_id()))
    parts = d.groupBy("_part", "_run").agg(F.min(loss).alias("_least"))
    earlier = F.min("_least").over(W.partitionBy("_run").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    b = parts.select(F.col("_part").alias("_p"), F.col("_run").alias("_r"), earlier.alias("_earlier"))
    own = F.min(loss).over(W.partitionBy("_part", "_run").orderBy(step).rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("_own", own).join(b, (F.col("_part") == F.col("_p")) & F.col("_run").eqNullSafe(F.col("_r")))
    best = F.least("_own", "_earlier")  # nulls are passed over
    return d.withColumn("is_best", best.isNull() | (F.col(loss) < best)).drop("_run", "_part", "_own", "_p", "_r", "_earlier")


def saturation(steps: DataFrame, size: str, next_size: str, p: str, alpha: float = 0.05) -> DataFrame:
    """End of the last significant step, if some step is not significant; else null."""
    hit = F.col(p) < alpha
    last, flat = F.max(F.when(hit, F.col(next_size))), F.min(F.when(~hit, F.col(size)))
    return steps.agg(F.when(flat.isNotNull(), F.coalesce(last, flat)).alias("saturation_size"), flat.alias("first_flat_size"))


def group_advantage(df: DataFrame, group: str, reward: str, epsilon: float = 1e-4) -> DataFrame:
    """(reward - mean) / (population deviation + epsilon) within each group.

    Mean and deviation combine before the shuffle and come back by an equi-join, so a hot
    group is not gathered."""
    m = df.groupBy(F.col(group).alias("_g")).agg(F.avg(reward).alias("_m"), F.stddev_pop(reward).alias("_s"))
    return df.join(m, F.col(group).eqNullSafe(F.col("_g"))).withColumn("advantage", (F.col(reward) - F.col("_m")) / (F.col("_s") + epsilon)).drop("_g", "_m", "_s")


def latest(df: DataFrame, key: str, priority: list[str]) -> DataFrame:
    """The row of each key with the greatest priority, later columns breaking ties, and after them the others."""
    others = [c for c in df.columns if c != key]
    ties = [c for c in others if c not in priority and "map<" not in dict(df.dtypes)[c]]  # maps have no order
    top = df.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*priority, *ties)).alias("_r"))
    return top.select(key, "_r.*")


def neighbours(df: DataFrame, group: str, order: str, role: str) -> DataFrame:
    """Opens and closes of runs of one role."""
    w = W.partitionBy(group).orderBy(order)
    prior, following = F.lag(role).over(w), F.lead(role).over(w)
    differs = lambda c: c.isNull() | (c != F.col(role))
    return df.withColumn("opens", differs(prior)).withColumn("closes", differs(following))


def lag_columns(df: DataFrame, group: str, order: str, columns: list[Column]) -> DataFrame:
    w = W.partitionBy(group).orderBy(order)
    return df.select("*", *[F.lag(c).over(w) for c in columns])
