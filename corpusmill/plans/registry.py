"""Every query of the library outside its optional parts, with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, curation, evaluation, scans, training

PLANS = (curation, evaluation, chat, scans, training)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for p in PLANS for k, v in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in PLANS for k, v in p.ORACLES.items()}
