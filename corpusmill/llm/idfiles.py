"""Token ids of whole tables as context-mixed, range-coded files in id order.

Rows are dealt by range of their id and sorted, so that a partition's files
follow each other and partitions do too.  Each writer streams its rows into
files of about ``file_ids`` ids in the shared folder and reports one row per
file; the ids before a partition are a sum over partitions, those before a file
within its partition are counted by the writer.  A lost task writes its files
again under the same names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mixcoder
from .common import atomic_output, id_text, open_store, shared_dir, small_batches, stored, tasks
from .words import word_table

MANIFEST = "part int, path string, base long, n_docs long, n_ids long, n_bytes long"


def write_id_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 1, file_ids: int = 4_000_000) -> DataFrame:
    """Write the files; returns their manifest (part, path, base: ids of the partition's
    files before it, n_docs, n_ids, n_bytes) as a stored table.

    Null and empty texts have the end id alone; repeated rows are written as often
    as they occur; rows with a null id are left out; an empty table has no files.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark, "idfiles")
    store, root = open_store(folder)
    store.create_dir(root)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        store, root = open_store(folder)
        table, part = word_table(tokenizer), TaskContext.get().partitionId()
        ids, lengths, data, held, base, number = [], [], [], 0, 0, 0

        def flush(docs: int):
            nonlocal ids, lengths, data, held, base, number
            path = f"{root}/part-{part:06d}-{number:04d}.cmx"
            size = sum(lengths[:docs])
            raw = mixcoder.pack_file(np.array(ids[:docs], np.int64), np.array(lengths[:docs]), np.frombuffer(b"".join(data[:docs]), "<u4"))
            with atomic_output(store, path) as out:
                out.write(raw)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), *(pa.array([x], pa.int64()) for x in (base, docs, size, len(raw)))], names=["part", "path", "base", "n_docs", "n_ids", "n_bytes"])
            ids, lengths, data, held, base, number = ids[docs:], lengths[docs:], data[docs:], held - size, base + size, number + 1
            return row

        full = 0  # documents of the next file, once there are enough
        for b in batches:
            for doc, x in zip(b.column(0).to_pylist(), table.encode_batch(b.column(1).to_pylist()), strict=True):
                ids.append(doc)
                data.append(x + end)
                lengths.append(len(x) // 4 + 1)
                held += lengths[-1]
                if held >= file_ids and not full:
                    full = len(ids)
                if held >= file_ids * 5 // 4:  # a shorter rest goes into the last file, as a small one costs more an id
                    yield flush(full)
                    full = len(ids) if held >= file_ids else 0
        if ids:
            yield flush(len(ids))

    rows = id_text(docs, id_col, text_col).repartitionByRange(tasks(spark), "id").sortWithinPartitions("id")
    manifest = stored(rows.mapInArrow(run, MANIFEST), "idfiles-manifest", False, folder)
    return manifest.withColumn("folder", F.lit(folder))


def read_id_files(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it), n_tokens, ids
    (little-endian unsigned 32-bit).  A damaged block or header raises."""
    spark = manifest.sparkSession
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row per partition
    before, at = [], 0
    for r in totals:
        before.append((r["part"], at))
        at += r["n"]
    offsets = spark.createDataFrame(before, "part int, before long")
    files = manifest.join(F.broadcast(offsets), "part").select("folder", "path", (F.col("base") + F.col("before")).alias("start"))

    def run(batches):
        for b in batches:
            for folder, path, start in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                store, _ = open_store(folder)
                with store.open_input_file(path) as f:
                    docs, lengths, ids = mixcoder.unpack_file(f.read())
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                raw = ids.astype("<u4").tobytes()
                for lo in range(0, len(docs), 2000):
                    hi = min(len(docs), lo + 2000)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(docs[lo:hi], pa.int64()), pa.array(starts[lo:hi] + start, pa.int64()), pa.array(lengths[lo:hi].astype(np.int64), pa.int64()),
                        pa.array([raw[4 * s : 4 * e] for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)], pa.binary()),
                    ], names=["doc_id", "start", "n_tokens", "ids"])

    return files.repartition(max(1, min(len(totals), tasks(spark)))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
