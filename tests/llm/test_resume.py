"""The pipeline with a ledger: a driver that dies within the fourth stage, and the run after it."""

from __future__ import annotations

import os
import subprocess
import sys
import textwrap
from collections import defaultdict

import corpus_pipeline


def covered(pieces):
    """Ids of each document, whatever the cuts."""
    out = defaultdict(list)
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        out[r["doc_id"]].append(bytes(r["ids"]))
    return {k: b"".join(v) for k, v in out.items()}


def test_a_rerun_reads_the_stages_that_are_done(spark, sf, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/ledger"
    script = tmp_path / "driver.py"
    script.write_text(textwrap.dedent(f"""
        import os, sys
        sys.path.insert(0, {os.path.dirname(os.path.abspath(corpus_pipeline.__file__))!r})
        from pyspark.sql import SparkSession
        import corpus_pipeline
        spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
        spark.sparkContext.setCheckpointDir({str(tmp_path / "shared")!r})
        spark.conf.set("corpusmill.ledger", {folder!r})
        name, stage = corpus_pipeline.STAGES[3]
        corpus_pipeline.STAGES[3] = (name, lambda *a: os._exit(9))
        corpus_pipeline.run(spark, {sf!r})
    """))
    died = subprocess.run([sys.executable, str(script)], timeout=600, capture_output=True)
    assert died.returncode == 9, died.stderr[-2000:]
    called = []
    noted = [(n, lambda s, d, at, n=n, f=f: (called.append(n), f(s, d, at))[1]) for n, f in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", noted)
    spark.conf.set(corpus_pipeline.LEDGER, folder)
    try:
        rows = corpus_pipeline.run(spark, sf).collect()
        assert called == ["repeated_passages", "packing"]
        assert corpus_pipeline.run(spark, sf).count() == len(rows) and len(called) == 2
    finally:
        spark.conf.unset(corpus_pipeline.LEDGER)
    assert covered(rows) == covered(corpus_pipeline.run(spark, sf).collect())
    assert len(called) == 7
