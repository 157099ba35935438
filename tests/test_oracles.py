"""Every registered query with an oracle against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from corpusmill.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    rel = duck.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    assert sorted(got.columns) == sorted(cols)
    want = sorted(tuple(repr(plain(r[cols.index(c)])) for c in sorted(cols)) for r in rel.fetchall())
    have = sorted(tuple(repr(plain(r[c])) for c in sorted(cols)) for r in got.collect())
    assert have == want


#: Ids of a tokenizer; tests/test_training.py has plain Python versions.
WITHOUT_SQL = {"pretraining_rows", "finetuning_rows", "finetuning_tool_rows", "preference_rows", "merge_counts", "piece_counts"}


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql()) | WITHOUT_SQL


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 4
