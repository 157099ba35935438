"""Sets by sketches and blocks, and bigrams as numbers, against plain Python and the column expressions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import dedup, joins, similarity, training

ODD = ["", None, " ", "a", "ab", " a　b ", "的", "是的", "a：", "\U0001f600", "\U0001f600x", "\x85\x1cab ", "ab ab  abc", "a\x00b", "x﻿y", "᠎a", "​b", "的a的b的c", "aab", "���", "\\-[]"]


def test_bigram_numbers_are_the_bigrams(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, text string").repartition(2)
    sizes = d.select("i", X.bigram_sizes("text").alias("n"), *[F.size(X.bigram_set("text", v)).alias(v) for v in X.GRAM_VARIANTS]).collect()
    assert {r["i"]: r["n"].asDict() for r in sizes} == {r["i"]: {v: r[v] for v in X.GRAM_VARIANTS} for r in sizes}
    pairs = d.select("i", *[X.bigram_codes("text", v).alias(f"c_{v}") for v in X.GRAM_VARIANTS], *[X.bigram_set("text", v).alias(f"s_{v}") for v in X.GRAM_VARIANTS]).collect()
    for v in X.GRAM_VARIANTS:
        for a in pairs:
            for b in pairs:
                assert len({*a[f"c_{v}"]} & {*b[f"c_{v}"]}) == len({*a[f"s_{v}"]} & {*b[f"s_{v}"]}), (v, a["i"], b["i"])


def family(r, n, low, high):
    base = [r.sample(range(1 << 40), high * 6 // 5) for _ in range(4)]
    return [(i, r.sample(base[r.randrange(4)], r.randint(low, high)), r.choice(["p", "q"])) for i in range(n)]


@pytest.mark.parametrize("threshold, low, high", [(0.85, 35, 44), (0.5, 1, 30), (0.9, 280, 330), (0.1, 1, 12), (1.0, 1, 3)])
def test_pairs_of_sets(spark, monkeypatch, threshold, low, high):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 40)  # several blocks, and several for one size
    rows = family(random.Random(3), 300, low, high)
    want = {(a[0], b[0]): len({*a[1]} & {*b[1]}) / len({*a[1]} | {*b[1]}) for a in rows for b in rows if a[2] == b[2]}
    want = {k: v for k, v in want.items() if v >= threshold}
    d = spark.createDataFrame(rows, "id long, g array<long>, label string").repartition(3).cache()
    assert {(r["a"], r["b"]): r["similarity"] for r in similarity.set_pairs(d, threshold).collect()} == {k: v for k, v in want.items() if k[0] < k[1]}
    few = d.where("id % 7 = 0")
    assert {(r["a"], r["b"]): r["similarity"] for r in similarity.set_pairs(d, threshold, few).collect()} == {k: v for k, v in want.items() if k[1] % 7 == 0}


def test_rows_that_share_an_id_or_have_names(spark):
    grams = [f"w{i}" for i in range(10)]
    named = spark.createDataFrame([("c", grams), ("a", grams[:9]), ("b", ["z"]), (None, grams)], "k string, g array<string>")
    assert [tuple(r) for r in dedup.similar_pairs(named, "k", "g", 0.85).collect()] == [("a", "c", 0.9)]
    shared = spark.createDataFrame([(1, grams), (1, grams[:9]), (2, grams), (3, ["z"])], "k int, g array<string>")
    got = sorted(tuple(r) for r in dedup.similar_pairs(shared, "k", "g", 0.85).collect())
    assert got == [(1, 2, 0.9), (1, 2, 1.0)]
    assert dedup.similar_pairs(named.where("k = 'x'"), "k", "g", 0.85).count() == 0


def test_greedy_rounds(spark, monkeypatch):
    monkeypatch.setattr(dedup, "FIRST_ROUND", 10)
    monkeypatch.setattr(dedup, "GROWTH", 2)
    rows, kept = family(random.Random(5), 200, 30, 36), []
    for i, g, _ in rows:
        if not any(len({*g} & k) >= 0.8 * len({*g} | k) for k in kept):
            kept.append({*g})
    d = spark.createDataFrame(rows, "id long, g array<long>, label string")
    got = {r["id"] for r in dedup.drop_near_duplicates(d, "id", "g", 0.8).collect()}
    assert [{*g} for i, g, _ in rows if i in got] == kept


@pytest.mark.parametrize("window", [64, 4])
def test_contained_items_of_all_lengths(spark, monkeypatch, window):
    monkeypatch.setattr(joins, "WINDOW", window)
    r = random.Random(4)
    docs = [(i, "".join(r.choice("ab\U0001f600") for _ in range(n))) for i, n in enumerate([0, 1, 5, 40, 90, 300, 900])] + [(9, "a" * 500)]
    cut = lambda t, n: t[(k := r.randrange(len(t) - n + 1)) : k + n]
    items = [(100 + n, cut(docs[6][1], n)) for n in [*range(1, 30), 70, 75, 76, 200, 900]] + [(1, ""), (2, "a" * 80), (3, "b" * 90), (4, docs[5][1] + "a"), (5, docs[4][1])]
    d, i = spark.createDataFrame(docs, "doc long, t string"), spark.createDataFrame(items, "item long, it string")
    want = {(a, b) for a, t in docs for b, x in items if x and x in t}
    assert {tuple(x) for x in joins.contained(d, "doc", "t", i, "item", "it").collect()} == want


def test_texts_are_encoded_a_few_at_a_time():
    texts = ["x" * n for n in (300_000, 0, 5, 199_990, 10, 1)] + [None] * 150
    lots = list(training.few_at_a_time(texts))
    assert [t for x in lots for t in x] == [t or "" for t in texts]
    assert all(len(x) <= training.ENCODED_ROWS and (len(x) == 1 or sum(map(len, x)) <= training.ENCODED_CHARS) for x in lots)
