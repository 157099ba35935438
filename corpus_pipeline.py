"""Documents to packed training sequences: five stages over whatever the one before kept.

Quality rules, exact duplicates, near duplicates (one document of each group stays),
repeated passages cut out of the texts, packing.  All but the last return the columns of
``documents``, with n_chars brought up to date where a text changes.  A stage is a
function of (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs.

Rows without an id are in no result.  Each row is judged for itself, also where rows share
an id: of rows with equal texts one stays, and rows with one id and different texts are
different documents.  Null texts count as empty ones and fail the quality rules.  Columns
besides those of ``documents`` pass through all stages but the last.

Where the session names a folder in ``corpusmill.ledger``, run() keeps every stage's result there and a later run over
the same files with the same code reads the stages that are done, so a driver that died goes on where it was.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import exact_dedup, near_dedup, packing, quality, substring_dedup
from corpusmill.llm.common import stored, sweep
from corpusmill.operators import stages as ledger
from corpusmill.sources.io import with_row_id

#: No stage can be told in SQL as a whole; tests/llm holds run() against plain Python.
ORACLE_SQL = None

ROW = "_pipeline_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number that names each row, in the order of ids.  It is the id itself, unless rows
    share one; then rows are numbered in the order of id and text, in a stored table."""
    docs = docs.where(F.col("doc_id").isNotNull())
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if shared.isEmpty():
        return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    order = F.xxhash64("text").alias(f"{ROW}_order")
    return stored(with_row_id(docs.select("*", order), ["doc_id", f"{ROW}_order"], ROW), "pipeline-numbered").drop(f"{ROW}_order")


def _kept(docs: DataFrame, rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows that verdicts (id, kept) keep.  The planner can't measure an operator's output
    beforehand, so it is told not to broadcast it."""
    keep = verdicts.where("kept").select(F.col("id").alias(ROW)).hint("merge")
    return rows.join(keep, ROW, "left_semi").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    return _kept(docs, rows, quality.robust_quality(rows, ROW))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    return _kept(docs, rows, exact_dedup.extendible_dedup(rows, ROW))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    return _kept(docs, rows, near_dedup.near_duplicates(rows, ROW))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out whole characters only; documents with nothing left go."""
    rows = _numbered(docs)
    out = substring_dedup.remove_repeats(rows, ROW, whole_chars=True)
    cut = out.select(F.col("id").alias(ROW), F.decode("kept", "UTF-8").alias(f"{ROW}_text"))
    named = rows.select(ROW, *[c for c in docs.columns if c not in ("text", "n_chars")])
    joined = named.join(cut.hint("merge"), ROW).where(F.col(f"{ROW}_text") != "")
    new = {"text": F.col(f"{ROW}_text"), "n_chars": F.length(f"{ROW}_text").cast("long")}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.harmonic_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", pack),
]


LEDGER = "corpusmill.ledger"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if folder := spark.conf.get(LEDGER, ""):
        return resume(spark, docs, sf_dir, folder).result
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        sweep(spark)
    return STAGES[-1][1](spark, docs, sf_dir)


def resume(spark: SparkSession, docs: DataFrame, sf_dir: str, folder: str) -> ledger.Run:
    """The stages over docs, a scan of files, with a ledger in folder; which of them were read is in the result."""

    def after_a_sweep(stage):
        def run_stage(before: DataFrame) -> DataFrame:
            sweep(spark)
            return stage(spark, before, sf_dir)

        return run_stage

    code = ledger.code_fingerprint("corpusmill", sys.modules[__name__])
    return ledger.run_stages(spark, folder, docs, [(n, after_a_sweep(f)) for n, f in STAGES], fingerprint=ledger.files_fingerprint(spark, docs), code=code)
