"""Set checks between key columns; each yields the offending keys, none if the check holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_keys(key: str, *sources: DataFrame) -> DataFrame:
    """U1"""
    out = sources[0].select(key)
    for s in sources[1:]:
        out = out.union(s.select(key))
    return out.distinct()


def not_subset(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of a that b lacks."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of both."""
    return a.select(key).intersect(b.select(key))


def difference(a: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """U4: rows of a whose key is in none of the others."""
    for o in others:
        a = a.join(o.select(key).distinct(), key, "left_anti")
    return a


def successive(df: DataFrame, key: str, stages: list) -> list[DataFrame]:
    """Results of stages, each over what the earlier ones left."""
    out = []
    for stage in stages:
        out.append(stage(difference(df, key, *out)))
    return out


def same_keys(m: Column, letters: list[str]) -> Column:
    """U6"""
    return F.coalesce(F.array_sort(F.map_keys(m)) == F.array(*map(F.lit, sorted(letters))), F.lit(False))
