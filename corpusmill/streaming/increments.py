"""Extra: the exact-deduplication and funnel operators over a stream of documents.

Each micro-batch's texts are met with the keys that earlier ones left in the state store;
the watermark bounds how long a key is remembered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_space


def dedup_stream(docs: DataFrame, text_col: str, time_col: str, remember: str = "1 day") -> DataFrame:
    """First copies of white-space-free texts within the watermark."""
    keyed = docs.withColumn("_key", F.sha2(norm_space(text_col), 256)).withWatermark(time_col, remember)
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def funnel_stream(docs: DataFrame, reason: Column, time_col: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per reason and window of event time; rows later than the watermark are left out."""
    d = docs.withWatermark(time_col, late).withColumn("reason", F.coalesce(reason, F.lit("kept")))
    return d.groupBy(F.window(time_col, window), "reason").agg(F.count(F.lit(1)).alias("n"))
