"""Membership joins, attribution, and strict joins that refuse missing keys.

Spark chooses the strategy from the sizes it measures; nothing here is broadcast unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import gram_minima
from ..sources.io import with_row_id


def exclude(df: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """Rows whose key is in none of the sources."""
    out = df
    for s in sources:
        out = out.join(s.select(key).distinct(), key, "left_anti")
    return out


def exclusions(entries: DataFrame, scope: str) -> DataFrame:
    """Keys that are excluded everywhere ("all") or from training alone ("train")."""
    train = F.coalesce(F.col("exclude_from") == "train", F.lit(False))
    return entries.where((F.col("decision") == "exclude") & (train if scope == "train" else ~train)).select("q_md5").distinct()


def attribute(df: DataFrame, key: str, external: DataFrame, source: str = "source", order: str = "ord") -> DataFrame:
    """The first source, in declared order, that has the key; null if none does."""
    first = external.groupBy(key).agg(F.min_by(source, order).alias("matched_source"))
    return df.join(first, key, "left")


def still_valid(pins: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """J6"""
    return pins.join(valid.select(key).distinct(), key, "left_semi")


def strict_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row of each side per key, columns of b prefixed b_; a key that either side lacks is an error."""
    left = a.withColumn("_in_a", F.lit(True))
    right = b.select(F.col(key), *[F.col(c).alias(f"b_{c}") for c in b.columns if c != key], F.lit(True).alias("_in_b"))
    d = left.join(right, key, "full_outer")
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    checked = F.when(both, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("key on one side only: "), F.col(key).cast("string"))).cast("boolean"))
    return d.where(checked).drop("_in_a", "_in_b")


def zip_rows(a: DataFrame, b: DataFrame, key: str, order_a: list[str], order_b: list[str]) -> DataFrame:
    """The rows of a and b in their orders side by side, columns of b prefixed b_; an error where the
    keys at a place differ or one side ends first."""
    left = with_row_id(a, order_a, "place")
    right = with_row_id(b, order_b, "place").select("place", *[F.col(c).alias(f"b_{c}") for c in b.columns])
    d = left.withColumn("_in_a", F.lit(True)).join(right.withColumn("_in_b", F.lit(True)), "place", "full_outer")
    same = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & F.col(key).eqNullSafe(F.col(f"b_{key}"))
    checked = F.when(same, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("rows differ at place "), F.col("place").cast("string"))).cast("boolean"))
    return d.where(checked).drop("_in_a", "_in_b", f"b_{key}")


def locked_join(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of a with ``intact``: b has the key and all columns are equal, nulls too."""
    right = b.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    same: Column = F.col("_there").isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(right, key, "left").withColumn("intact", same).drop("_there", *[f"_{c}" for c in columns])


def back_reference(df: DataFrame, raw: DataFrame, columns: list[str], row: str = "source_row") -> DataFrame:
    """Df with the columns of the raw row that it names by its number from 1."""
    return df.join(raw.select(F.col("row_id").alias(row), *[F.col(c).alias(f"raw_{c}") for c in columns]), row, "left")


def overlap(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys in more than one split, and in how many."""
    return df.groupBy(key).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


#: Hashes of which each item's least one is among those that documents give.
WINDOW = 64


def contained(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, gram: int = 12) -> DataFrame:
    """Extension of J2: (doc, item) where a normalised document contains a normalised item.

    Both give the least gram hashes of their windows; what a document contains gives none that the document lacks.
    An item's hash that is rarest among the items is its anchor; documents meet items at anchors by an equi-join, and contains()
    settles each candidate.  Both texts are as given by the columns.  Items are taken by the widest window, up to WINDOW, that
    they fill; those under gram characters are their own gram."""
    i = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("it")).where("it <> ''")
    n = F.least(F.length("it"), F.lit(gram))
    room = F.least(F.length("it") - n + 1, F.lit(WINDOW))
    i = i.withColumns({"n": n, "window": F.pow(F.lit(2), F.floor(F.log2(room + 0.5))).cast("int")})
    kinds = sorted(tuple(r) for r in i.select("n", "window").distinct().collect())  # at most gram + log2(WINDOW) rows
    out = None
    d = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("dt"))
    for n, window in kinds:
        part = i.where((F.col("n") == n) & (F.col("window") == window)).select("item", "it")
        each = part.select("item", F.explode(gram_minima("it", n, window)).alias("gram"))
        rare = each.groupBy("gram").agg(F.count(F.lit(1)).alias("f"))
        anchor = each.join(rare, "gram").groupBy("item").agg(F.min_by("gram", F.struct("f", "gram")).alias("gram"))
        seen = d.select("doc", F.explode(gram_minima("dt", n, window)).alias("gram"))
        pairs = seen.join(anchor, "gram").select("doc", "item").distinct()
        hit = pairs.join(d, "doc").join(part, "item").where(F.contains("dt", "it")).select("doc", "item")
        out = hit if out is None else out.union(hit)
    return out if out is not None else d.select("doc", F.lit(None).cast("long").alias("item")).limit(0)
