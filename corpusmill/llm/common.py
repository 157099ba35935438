"""Shared plumbing of the training-data operators.

Shared folder: every intermediate table or file lives under the folder the
session names in ``spark.checkpoint.dir``; only where that is unset on a local
master (tests) is a temporary one made and set, elsewhere that is an error.  Files are reached with
``pyarrow.fs``, so the folder may be any store that it opens.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space between words, as a Java and Python character class.
SPACE = r"\x20\x09-\x0D"

#: Folders of this driver, and what shows whether a plan can still read one.
_made: dict[str, object] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share; removed when no plan can read it any
    more (live_with()), at the latest when the driver ends."""
    sweep()
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="corpusmill-")
        sc.setCheckpointDir(base)
        _made[base] = None
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base
    path = f"{base.rstrip('/')}/corpusmill/{name}-{uuid.uuid4().hex[:12]}"
    _made[path] = None
    return path


def live_with(df: DataFrame, *paths: str) -> DataFrame:
    """df, a scan or the result of a function over Arrow batches; paths may go when neither it nor
    a plan made from it is left.  What all such plans share is held weakly: the scan's list
    of files, or the function."""
    plan = df._jdf.queryExecution().analyzed()
    scan = plan.getClass().getSimpleName() == "LogicalRelation"
    shared = plan.relation().location() if scan else plan.functionExpr().func()
    for path in paths:
        _made[path] = df.sparkSession._jvm.java.lang.ref.WeakReference(shared)
    return df


def sweep(spark: SparkSession | None = None) -> None:
    """Remove folders that no plan can read any more; with spark, collect garbage first."""
    if spark is not None:
        gc.collect()
        spark._jvm.System.gc()
    for path, held in list(_made.items()):
        if held is not None and held.get() is None:
            _remove(path)


def _remove(path: str) -> None:
    _made.pop(path, None)
    store, at = open_store(path)
    with contextlib.suppress(FileNotFoundError):
        store.delete_dir(at)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's address, and the path in it."""
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


@atexit.register
def _remove_made() -> None:
    for path in list(_made):
        with contextlib.suppress(Exception):
            _remove(path)


@contextlib.contextmanager
def atomic_output(store: pafs.FileSystem, path: str):
    """A stream whose file appears under its name only when it is whole, so that a
    retried or speculative task can only replace it by the same content."""
    temp = f"{path}.{uuid.uuid4().hex[:8]}.part"
    with store.open_output_stream(temp, compression=None) as out:
        yield out
    store.move(temp, path)


def stored(df: DataFrame, name: str, narrow: bool = False, *folders: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage at a table
    that every executor can read.  Wide columns are compressed before they come
    here; small row groups bound what a writing task buffers.  narrow: rows of a few
    numbers, which a quarter of the tasks write, as each file costs a task more than they do.
    folders are of use only to readers of the table and go with it."""
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(8, tasks(spark) // 4))
    path = shared_dir(spark, name)
    df.write.option("compression", "uncompressed").option("parquet.block.size", 8 << 20).parquet(path)
    return live_with(spark.read.schema(df.schema).parquet(path), path, *folders)


#: How to empty the caches of the operators that this worker process has run.
_caches: dict[str, Callable[[], None]] = {}


def own_cache(name: str, clear: Callable[[], None]) -> None:
    """Called by a task that is about to fill its operator's cache.  A worker process serves one operator
    after the other; the caches of those before are emptied, so that they don't add up."""
    for other in [k for k in _caches if k != name]:
        _caches.pop(other)()
    _caches[name] = clear


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly (id long, text string): other columns cannot clash, null text is
    empty, and rows without an id, which no result could name, are left out."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return d.where(F.col("id").isNotNull())


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows that go to a Python worker at a time; bounds its memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
    """(id, text) of Arrow batches of id_text()."""
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
