"""Scans along long sequences, medians, choices of tokens, digests and first lines against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import decoding
from corpusmill.operators import aggregates, scans
from corpusmill.sources import io


def test_a_scan_of_a_million_steps(spark):
    n = 1_000_000
    d = spark.range(n).select(F.lit("one").alias("s"), F.col("id").alias("t"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("b"), F.when(F.col("id") % 1000 == 0, 1.0).otherwise(0.97).alias("a"))
    rows = {r["t"]: (r["a"], r["b"], r["x"], r["x_next"]) for r in scans.reverse_scan(d, "s", "t", "a", "b", "x").where("t % 997 < 2").collect()}
    b = [r["b"] for r in d.select("b").collect()]
    want, after = 0.0, 0.0
    for t in range(n - 1, -1, -1):
        want, after = b[t] + (1.0 if t % 1000 == 0 else 0.97) * want, want
        if t % 997 < 2:
            assert rows[t][:2] == ((1.0 if t % 1000 == 0 else 0.97), b[t])
            assert math.isclose(rows[t][2], want, rel_tol=1e-9) and math.isclose(rows[t][3], after, rel_tol=1e-9)


def plain_scan(rows):
    out, by = {}, {}
    for s, t, a, b in rows:
        by.setdefault(s, []).append((t, a or 0.0, b or 0.0))
    for s, own in by.items():
        x = 0.0
        for k, (t, a, b) in enumerate(sorted(own, reverse=True)):
            x = b + (a * x if k else 0.0)
            out[s, t] = x
    return out


@pytest.mark.parametrize("sizes", [[1] * 40, [500], [3, 400, 1, 2, 90], []])
def test_scans_of_many_sequences(spark, sizes):
    r = random.Random(4)
    rows = [(f"s{k}" if k else None, t, r.choice([0.5, -1.0, 0.0, None]), r.choice([r.random(), None])) for k, n in enumerate(sizes) for t in r.sample(range(10_000), n)]
    d = spark.createDataFrame(rows, "s string, t int, a double, b double").withColumns({"extra": F.lit("x"), "value": F.lit(1)})
    got = scans.reverse_scan(d, "s", "t", "a", "b", "x")
    assert got.columns == [*d.columns, "x", "x_next"]
    want = plain_scan(rows)
    have = {(x["s"], x["t"]): x["x"] for x in got.collect()}
    assert have.keys() == want.keys() and all(math.isclose(have[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)


@pytest.mark.parametrize("lam", [0.8, 0.0])
def test_advantages_of_long_sequences(spark, lam):
    r = random.Random(6)
    rows = [(k, t, r.random(), r.random()) for k, n in enumerate([200, 1, 30]) for t in range(n)]
    got = {(x["k"], x["t"]): x["advantage"] for x in scans.long_advantages(spark.createDataFrame(rows, "k int, t int, r double, v double"), "k", "t", "r", "v", 0.9, lam).collect()}
    for k in range(3):
        own, a, v = [x for x in rows if x[0] == k], 0.0, 0.0
        for _, t, reward, value in reversed(own):
            a = reward + 0.9 * v - value + 0.9 * lam * a
            v = value
            assert math.isclose(got[k, t], a, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("few", [10_000, 1])
def test_medians(spark, monkeypatch, few):
    monkeypatch.setattr(aggregates, "MEDIAN_FEW", few)
    r = random.Random(3)
    groups = {"even": [r.random() for _ in range(3000)], "odd": [r.gauss(0, 1e9) for _ in range(2001)], "same": [2.5] * 999, "two": [1.0, 4.0], "one": [7.0], "powers": [10.0 ** r.uniform(-300, 300) for _ in range(501)],
              "ends": [-math.inf, 1.0, math.inf, 3.0], "far": [1.7e308, -1.7e308, 1.6e308], "ties": [1.0] * 500 + [2.0] * 500, None: [5.0, 6.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("odd", None)]
    r.shuffle(rows)
    got = {x["g"]: x["median"] for x in aggregates.median(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", ["g"]).collect()}
    assert got.pop("none") is None and got.keys() == groups.keys()
    assert all(math.isclose(got[g], statistics.median(vs), rel_tol=1e-12) for g, vs in groups.items())
    d = spark.createDataFrame(rows, "g string, v double")
    assert math.isclose(aggregates.median(d, "v").first()["median"], statistics.median(v for _, v in rows if v is not None))
    assert aggregates.median(d.where("g = 'ends'"), "v").first()["median"] == 2.0
    assert aggregates.median(spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, 2.0)], "g int, v double"), "v", ["g"]).first()["median"] == 2.0
    assert aggregates.median(d.limit(0), "v", ["g"]).count() == 0


def plain_choice(scores, seen, banned, u, temperature, k, p, penalty, greedy):
    s = [-math.inf if x is None else x / temperature for x in scores or []]
    for i in set(seen or []):
        if i is not None and 0 <= i < len(s):
            s[i] = s[i] / penalty if s[i] > 0 else s[i] * penalty
    for i in banned or []:
        s[i] = -math.inf
    ids = sorted((i for i in range(len(s)) if s[i] > -math.inf), key=lambda i: (-s[i], i))
    if not ids:
        return None, None, None
    if 0 < k < len(s):
        ids = [i for i in ids if s[i] >= sorted(s, reverse=True)[k - 1]]
    e = {i: math.exp(s[i] - s[ids[0]]) for i in ids}
    total, mass, kept = sum(e.values()), 0.0, []
    for i in ids:
        if p < 1 and mass > p:
            break
        kept.append(i)
        mass += e[i] / total
    total, at = sum(e[i] for i in kept), 0.0
    if greedy:
        return min(kept, key=lambda i: (-e[i], i)), max(e[i] for i in kept) / total, len(kept)
    for i in sorted(kept):
        at += e[i] / total
        if at > u:
            break
    return i, e[i] / total, len(kept)


@pytest.mark.parametrize("options", [{}, {"top_k": 3}, {"top_k": 0, "top_p": 0.5}, {"top_p": 1.0, "top_k": 0, "penalty": 2.0}, {"greedy": True}, {"top_k": 1}, {"top_p": 0.0}])
def test_choices_of_tokens(spark, options):
    r = random.Random(9)
    rows = [([round(r.uniform(-3, 3), 1) for _ in range(r.randint(1, 12))], [r.randint(-1, 12) for _ in range(r.randint(0, 5))], [], r.random()) for _ in range(150)]
    rows += [([1.0, 1.0, 1.0], None, [0], 0.999999), ([1.0, None], [0], None, 0.0), ([], [], [], 0.5), (None, None, None, 0.5), ([2.0], [], [0], 0.1), ([5.0, 5.0], [], [], 0.0)]
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, s array<double>, seen array<int>, no array<int>, u double")
    got = d.select("i", decoding.choose_token(F.col("s"), F.col("seen"), F.col("no"), F.col("u"), **options).alias("c")).orderBy("i").collect()
    full = {"temperature": 0.85, "top_k": 50, "top_p": 0.85, "penalty": 1.0, "greedy": False} | options
    for x, g in zip(rows, got, strict=True):
        token, probability, n = plain_choice(*x, full["temperature"], full["top_k"], full["top_p"], full["penalty"], full["greedy"])
        assert (g["c"]["token"], g["c"]["candidates"]) == (token, n), x
        assert probability is None or math.isclose(g["c"]["probability"], probability, rel_tol=1e-12)


def test_draws_follow_the_probabilities_and_rows_end(spark):
    d = spark.range(20_000).select(decoding.choose_token(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)), F.array().cast("array<int>"), F.array().cast("array<int>"), (F.col("id") + 0.5) / 20_000, temperature=1.0, top_k=0, top_p=1.0)["token"].alias("t"))
    share = {r["t"]: r["count"] / 20_000 for r in d.groupBy("t").count().collect()}
    e = np.exp([0.0, 1.0, 2.0])
    assert all(abs(share[i] - e[i] / e.sum()) < 2e-4 for i in range(3))
    got = spark.createDataFrame([([5, 2, 7, 2],), ([1, 3],), ([],), (None,)], "t array<int>").select(decoding.finished_after(F.col("t"), 2).alias("x")).collect()
    assert [r["x"] for r in got] == [[5, 2, 2, 2], [1, 3], [], None]


def test_digests_go_through_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "CHUNK", 1000)
    files = {"a.bin": b"x" * 12_345, "with space %20é.bin": b"\x00\xff" * 700, "none.bin": b""}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[1]: (r["md5"], r["sha256"], r["length"]) for r in io.file_digests(spark, str(tmp_path)).collect()}
    want = {n: (hashlib.md5(x).hexdigest(), hashlib.sha256(x).hexdigest(), len(x)) for n, x in files.items()}
    assert got == want
    monkeypatch.setattr(io, "STREAMED", ("other",))  # whole files in rows, without empty ones
    assert {r["path"].rsplit("/", 1)[1]: (r["md5"], r["sha256"], r["length"]) for r in io.file_digests(spark, str(tmp_path)).collect()} == {n: w for n, w in want.items() if w[2]}


@pytest.mark.parametrize("part", ["200", "128m"])
def test_first_lines_of_files_in_splits(spark, tmp_path, part):
    lines = [f"line {i} " + "x" * (i * 7 % 50) for i in range(120)]
    for k, (lo, hi) in enumerate([(0, 40), (40, 41), (41, 41), (41, 120)]):
        (tmp_path / f"f{k}.txt").write_text("".join(x + "\n" for x in lines[lo:hi]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", part)
    try:
        for n in (0, 1, 40, 41, 60, 119, 500):
            got = sorted((r["line"], r["value"]) for r in io.first_lines(spark, str(tmp_path), n).collect())
            assert got == list(enumerate(lines))[:n]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "rangepartitioning" not in io.first_lines(spark, str(tmp_path), 60)._jdf.queryExecution().executedPlan().toString()
