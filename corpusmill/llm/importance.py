"""Target-distribution importance resampling over hashed word n-grams.

Texts become rows of a sparse count matrix, documents by buckets, persisted in CSR blocks: a block is one row
of a table with the ids of its documents, row pointers, and the buckets and counts of their non-zero cells.  Column
sums of the blocks are the corpus's distribution, the same over target texts the target's; a bucket's gain is
the floor of 1000 times the logarithm of their smoothed ratio.  A document's weight is its row times the gains, a
sparse matrix-vector product block by block.  Gumbel noise from the document's id makes the top of weight + noise a draw
without replacement in proportion to the exponential of the weights.

Cells are kept as steps between buckets, and compressed, so the matrix takes less room than the texts.  A text of
any length goes through in pieces of bounded size.  Only sums of one column per bucket reach the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import with_row_id
from .common import id_text, rows_of, stored

#: A-Z to a-z, other ASCII signs but 0-9 and a-z to the space; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at a time, and cells after which a block closes.
PIECE, CELLS = 1 << 20, 1 << 19
#: Documents after which a block closes.
DOCS = 4096

BLOCKS = "docs int, ids binary, words binary, features binary, pointers binary, cells binary"


def pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, those of some PIECE bytes at a time."""
    folded, at = raw.translate(FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def feature_hashes(words: list[bytes], before: list[bytes], longest: int) -> Iterator[list[int]]:
    """CRC-32 of the runs of 1 to longest words that end in words; before: the words in front of them.
    A run's hash goes on from that of the run without its last word."""
    every = [*before, *words]
    joined = [b" " + w for w in every]
    last = list(map(zlib.crc32, every))
    yield last[len(before) :]
    for n in range(1, longest):
        last = list(map(zlib.crc32, joined[n:], last))
        yield last[max(0, len(before) - n) :]


def text_counts(text: str, buckets: int, longest: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(words, features, buckets in ascending order, their counts) of a text."""
    n_words, n_features, before, total = 0, 0, [], None
    for words in pieces(text.encode()):
        hashes = [np.array(h, np.uint32) for h in feature_hashes(words, before, longest)]
        found, counts = np.unique(np.concatenate(hashes) % np.uint32(buckets), return_counts=True)
        n_words += len(words)
        n_features += sum(map(len, hashes))
        before = [*before, *words][-(longest - 1) :] if longest > 1 else []
        if total is None:
            total = (found, counts)
        else:
            dense = np.zeros(buckets, np.int64)
            for f, c in (total, (found, counts)):
                dense[f] += c
            found = np.flatnonzero(dense)
            total = (found, dense[found])
    found, counts = total or (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return n_words, n_features, found.astype(np.int64), counts.astype(np.int64)


def _packed(found: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    """Non-zero cells of a block: a row's first bucket, then the steps to the next ones, and all counts."""
    steps = [np.diff(f, prepend=0) for f in found]
    both = np.concatenate([*steps, *counts]) if steps else np.zeros(0, np.int64)
    planes = both.astype("<u4").view(np.uint8).reshape(-1, 4).T  # high bytes are mostly zero
    return zstandard.compress(planes.tobytes(), 1)


def block_cells(packed: bytes, pointers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a block's cells, row by row."""
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8)
    both = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    steps, counts = np.split(both, 2)
    sums = np.concatenate(([0], np.cumsum(steps)))
    return sums[1:] - np.repeat(sums[pointers[:-1]], np.diff(pointers)), counts


def count_blocks(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """CSR blocks of (id, text) rows."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        ids, words, features, found, counts = zip(*rows, strict=True)
        pointers = np.concatenate(([0], np.cumsum([len(f) for f in found])))
        raw = [np.array(x, "<i8").tobytes() for x in (ids, words, features, pointers)]
        cells = [pa.array([x], pa.binary()) for x in (*raw, _packed(list(found), list(counts)))]
        return pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int32()), *cells], names=["docs", "ids", "words", "features", "pointers", "cells"])

    def run(batches):
        rows, cells = [], 0
        for i, text in rows_of(batches):
            n_words, n_features, found, counts = text_counts(text, buckets, longest)
            rows.append((i, n_words, n_features, found, counts))
            cells += len(found)
            if cells >= CELLS or len(rows) >= DOCS:
                yield block(rows)
                rows, cells = [], 0
        if rows:
            yield block(rows)

    return texts.mapInArrow(run, BLOCKS)


def column_sums(blocks: DataFrame, buckets: int) -> np.ndarray:
    """Counts of each bucket over all blocks; each task gives one row per bucket at most."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for pointers, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, counts = block_cells(cells, np.frombuffer(pointers, "<i8"))
                np.add.at(total, found, counts)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    sums = blocks.select("pointers", "cells").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # a row per bucket
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed target and corpus distributions, per bucket."""
    k, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: (float(t + 1) * float(s_all + k)) / (float(s + 1) * float(t_all + k))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def block_weights(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of each document: its row of the matrix times the gains."""

    def run(batches):
        for b in batches:
            for ids, words, features, pointers, cells in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                at = np.frombuffer(pointers, "<i8")
                found, counts = block_cells(cells, at)
                sums = np.concatenate(([0], np.cumsum(counts * gains[found])))
                cols = [*(np.frombuffer(x, "<i8") for x in (ids, words, features)), sums[at[1:]] - sums[at[:-1]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "n_words", "n_features", "weight"])

    return blocks.select("ids", "words", "features", "pointers", "cells").mapInArrow(run, "id long, n_words long, n_features long, weight long")


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", *, buckets: int = 10_000, longest: int = 3, least_words: int = 20, percent: int = 5, seed: int = 42) -> DataFrame:
    """One row per row of docs: id, n_words, n_features, weight, score and rank.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters; features are all runs of 1 to
    longest words, joined by a space, hashed by CRC-32.  Of the documents with at least least_words words,
    percent of a hundred (rounded down) with the highest scores are drawn; rank counts them from 1, ties to the smaller id, and
    is null for the rest.

    Null text has no words; a text without words has weight 0.  Rows with a null id are left out.  Repeated rows
    are documents of their own, each with a rank of its own.  Without target texts every bucket's target count is 0.
    An empty table gives an empty result."""
    blocks = stored(count_blocks(id_text(docs, id_col, text_col), buckets, longest), "importance-blocks")
    wanted = target.select(F.lit(0).cast("long").alias("id"), F.coalesce(F.col(target_col).cast("string"), F.lit("")).alias("text"))
    gains = bucket_gains(column_sums(blocks, buckets), column_sums(count_blocks(wanted, buckets, longest), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = stored(block_weights(blocks, gains).withColumn("score", F.col("weight") + noise), "importance-scores", True)
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    placed = with_row_id(able.withColumn("_down", -F.col("score")), ["_down", "id"], "_place").drop("_down")
    ranked = placed.withColumn("rank", F.when(F.col("_place") < drawn, F.col("_place") + 1)).drop("_place")
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
