"""Greedy removal on long chains, random graphs and large families, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dedup


def plain_greedy(rows, edges):
    near, kept = {}, set()
    for a, b in edges:
        near.setdefault(max(a, b), []).append(min(a, b))
    for r in sorted(rows):
        if not any(x in kept for x in near.get(r, [])):
            kept.add(r)
    return kept


def edge_frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long").repartition(4)


def test_a_chain_of_5000_links(spark):
    edges = [(i + 1, i) for i in range(5000)]
    got = {r["row"] for r in dedup.greedy_drop(spark.range(5001).withColumnRenamed("id", "row"), "row", edge_frame(spark, edges)).collect()}
    assert got == set(range(0, 5001, 2))


@pytest.mark.parametrize("small", [200_000, 12, 0])
def test_random_graphs(spark, small):
    r = random.Random(8)
    edges = [tuple(r.sample(range(k * 20, k * 20 + 20), 2)) for k in range(12) for _ in range(r.randint(0, 25))]
    rows = spark.range(240).withColumnRenamed("id", "row")
    assert {x["row"] for x in dedup.greedy_drop(rows, "row", edge_frame(spark, edges), small).collect()} == plain_greedy(range(240), edges)


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(101, 100), (103, 100), (103, 102)] + [(200 + i, 200) for i in range(1, 30)]
    got = {(r["node"], r["root"]) for r in dedup.components(spark.createDataFrame(edges, "late long, early long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 104)} | {(i, 200) for i in range(200, 230)}
    assert dedup.components(spark.createDataFrame([], "late long, early long")).count() == 0


def plain_near(rows, threshold, block):
    kept = []
    for i, g, b in sorted(rows, key=lambda r: r[0]):
        g = set(g)
        if g and not any(kb == b and len(g & k) >= threshold * len(g | k) - 1e-12 for k, kb in kept):
            kept.append((g, b))
            yield i


@pytest.mark.parametrize("block", [None, ["b"]])
def test_near_rows_of_families(spark, block):
    r = random.Random(2)
    base = [[f"g{k}_{i}" for i in range(30)] for k in range(3)]
    rows = [(i, r.sample(base[k := r.randrange(3)], r.choice([26, 28, 30])) + [f"x{r.randrange(6)}" for _ in range(r.randrange(5))], r.choice(["p", "q", None])) for i in range(260)]
    rows = [(i, sorted(set(g)), b) for i, g, b in rows] + [(900, [], "p"), (901, ["lone"], "q")]
    d = spark.createDataFrame(rows, "row long, g array<string>, b string").repartition(4)
    got = sorted(x["row"] for x in dedup.drop_near_duplicates(d, "row", "g", 0.8, block).collect())
    assert got == list(plain_near([(i, g, b if block else 0) for i, g, b in rows], 0.8, block))


def test_a_family_of_many_rows_takes_a_comparison_each(spark):
    """All but every thousandth row are alike; a pair of each two of them would be 2 * 10 ** 8."""
    own = F.array(*[F.concat(F.lit("v"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(50)).cast("string")) for k in range(2)])
    alone = F.col("id") % 1000 == 999
    grams = F.when(alone, F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.col("id").cast("string"), F.lit("_"), i.cast("string")))).otherwise(F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.lit("t"), i.cast("string"))), own)))
    d = spark.range(20_000).select(F.col("id").alias("row"), grams.alias("g"))
    got = sorted(x["row"] for x in dedup.drop_near_duplicates(d, "row", "g", 0.85).collect())
    assert got == [0, *range(999, 20_000, 1000)]
