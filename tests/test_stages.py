"""Resumable stages: what is read, what is computed anew, and what a dead driver leaves."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import stages as S


class Calls:
    """Three stages that note when they are called."""

    def __init__(self):
        self.seen = []

    def stages(self, factor=2):
        def noted(name, f):
            def stage(df):
                self.seen.append(name)
                return f(df)

            return name, stage

        return [noted("even", lambda d: d.where("id % 2 = 0")), noted("scaled", lambda d: d.withColumn("x", F.col("id") * factor)), noted("total", lambda d: d.agg(F.sum("x").alias("x")))]


def run(spark, folder, calls, first=None, **options):
    first = spark.range(100) if first is None else first
    out = S.run_stages(spark, folder, first, calls.stages(), fingerprint=S.content_fingerprint(first), **options)
    return out.result.first()["x"], [d.reused for d in out.stages]


@pytest.fixture()
def folder(tmp_path):
    return f"file://{tmp_path}/ledger"


def test_a_rerun_reads_every_stage(spark, folder):
    calls = Calls()
    assert run(spark, folder, calls) == (4900, [False] * 3)
    assert run(spark, folder, calls) == (4900, [True] * 3)
    assert calls.seen == ["even", "scaled", "total"]


def test_changes_count_from_where_they_are(spark, folder):
    calls = Calls()
    run(spark, folder, calls, params={"scaled": {"factor": 2}})
    calls.seen.clear()
    assert run(spark, folder, calls, params={"scaled": {"factor": 3}})[1] == [True, False, False]
    assert run(spark, folder, calls, params={"scaled": {"factor": 2}}, code="other")[1] == [False] * 3
    assert run(spark, folder, calls, spark.range(101))[0] == 5100
    assert run(spark, folder, calls, params={"scaled": {"factor": 2}})[1] == [True] * 3


def test_a_result_is_not_trusted_without_its_files(spark, folder, tmp_path):
    calls = Calls()
    run(spark, folder, calls)
    record = next(p for p in (tmp_path / "ledger").glob("scaled-*.json"))
    data = tmp_path / "ledger" / json.loads(record.read_text())["data"]
    part = next(p for p in data.glob("part-*"))
    part.write_bytes(part.read_bytes()[:-1])
    assert run(spark, folder, calls) == (4900, [True, False, True])
    assert S.prune(spark, folder) == [data.name]
    assert run(spark, folder, calls) == (4900, [True] * 3)


def test_start_at_and_only(spark, folder):
    calls = Calls()
    with pytest.raises(RuntimeError):
        run(spark, folder, calls, only="scaled")
    run(spark, folder, calls)
    assert run(spark, folder, calls, start_at="scaled")[1] == [True, False, False]
    first = spark.range(100)
    out = S.run_stages(spark, folder, first, calls.stages(), fingerprint=S.content_fingerprint(first), only="scaled")
    assert [d.reused for d in out.stages] == [True, False] and out.result.count() == 50
    for bad in ({"only": "none"}, {"start_at": "none"}):
        with pytest.raises(ValueError):
            run(spark, folder, calls, **bad)
    with pytest.raises(ValueError):
        S.run_stages(spark, folder, first, [("a", lambda d: d)] * 2, fingerprint="")


def test_fingerprints(spark, tmp_path):
    d = spark.createDataFrame([(1, None, "a"), (2, "x", None), (2, "x", None)], "a int, b string, c string")
    same = d.repartition(3).orderBy(F.desc("a"))
    assert S.content_fingerprint(d) == S.content_fingerprint(same)
    for other in (d.limit(2), d.distinct(), d.select("a", F.col("c").alias("b"), F.col("b").alias("c")), d.withColumn("a", F.col("a") + 1)):
        assert S.content_fingerprint(other) != S.content_fingerprint(d)
    path = str(tmp_path / "t")
    d.write.parquet(path)
    before = S.files_fingerprint(spark, spark.read.parquet(path))
    assert before == S.files_fingerprint(spark, spark.read.parquet(path))
    d.write.mode("append").parquet(path)
    assert before != S.files_fingerprint(spark, spark.read.parquet(path))
    assert S.code_fingerprint(S) != S.code_fingerprint("corpusmill.operators") != S.code_fingerprint("corpusmill")


def test_a_killed_driver_leaves_whole_stages(spark, folder, tmp_path):
    """A driver dies within its third stage, having written half of it; the next one reads the two before."""
    script = tmp_path / "driver.py"
    script.write_text(textwrap.dedent(f"""
        import os, sys
        sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
        from pyspark.sql import SparkSession
        from corpusmill.operators import stages as S
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        first = spark.range(100)
        def dies(d):
            d.write.parquet({folder!r} + "/total-half")
            os._exit(9)
        todo = [("even", lambda d: d.where("id % 2 = 0")), ("scaled", lambda d: d.selectExpr("id", "id * 2 AS x")), ("total", dies)]
        S.run_stages(spark, {folder!r}, first, todo, fingerprint=S.content_fingerprint(first))
    """))
    assert subprocess.run([sys.executable, str(script)], timeout=200, capture_output=True).returncode == 9
    calls = Calls()
    assert run(spark, folder, calls) == (4900, [True, True, False])
    assert calls.seen == ["total"]
    assert S.prune(spark, folder) == ["total-half"]
