"""Vector codes by partial-distance search: each vector becomes a byte-sized index per part.

Components become integers, floor(scale * x), and vectors are cut into equal consecutive parts, each position with a
codebook of its own.  Codebooks start as the parts of the vectors with the least ids and are refined in rounds: a
part goes to its nearest entry (squared Euclidean distance, ties to the lower index), then an entry becomes the
componentwise floor of its parts' mean; unused entries stay.

Search: a part's dimensions are taken in descending variance over the codebook's entries, so that distances
grow early.  Entry after entry, the squared differences of one dimension are added for the parts that are still
in the race; a mask drops those whose integer sum strictly exceeds their best complete distance so far.  Sums that reach
the last dimension are complete; a smaller one takes the part over, so an equal one leaves it with the lower index.

A round is one pass over the vectors: each task adds up its own parts by entry, and only those sums (parts x entries
rows a task) are shuffled.  Codebooks have a size set by parameters and travel with the tasks.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Components that a worker turns to integers at a time.
SLICE = 1 << 19
#: Integers below this keep every sum of squared differences of a part, and every task's sum, within 64 bits.
FAST = 1 << 24
#: Copies of a label's sum, over which rows with that label are spread when they meet it.
SALT = 16
#: A sum goes through the shuffle in digits of so many bits, so that one of any size adds up in 64-bit numbers.
DIGIT = 40
#: Sums of 64-bit errors add up in decimals.
WIDE = "decimal(38,0)"


def search_order(book: np.ndarray) -> np.ndarray:
    """Dimensions of a codebook (entries x dimensions) in descending variance, ties to the lower."""
    b = book.astype(object)  # exact
    spread = [len(b) * sum(x * x for x in col) - sum(col) ** 2 for col in b.T]
    return np.array(sorted(range(len(spread)), key=lambda j: (-spread[j], j)), dtype=np.int64)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of book to each of parts, both of integers."""
    order = search_order(book)
    columns = [np.ascontiguousarray(parts[:, j]) for j in order]
    best = np.zeros(len(parts), np.int64)
    least = np.zeros(len(parts), parts.dtype)
    for x, c in zip(columns, book[0, order], strict=True):
        least += (x - c) ** 2
    for k in range(1, len(book)):
        rows, partial, bound = np.arange(len(parts)), np.zeros_like(least), least
        for x, c in zip(columns, book[k, order], strict=True):
            partial += ((x if len(rows) == len(x) else x[rows]) - c) ** 2
            alive = partial <= bound
            if not alive.all():
                rows, partial, bound = rows[alive], partial[alive], bound[alive]
            if not len(rows):
                break
        better = partial < bound
        won = rows[better]
        best[won], least[won] = k, partial[better]
    return best, least


def integers(flat: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) as rows of dims; of Python's whole numbers where 64 bits would not do."""
    x = np.floor(flat.astype(np.float64) * scale)
    if not np.abs(x).max(initial=0) < FAST:
        return np.array([int(v) for v in np.floor(flat.astype(np.longdouble) * scale)], dtype=object).reshape(-1, dims)
    return x.astype(np.int64).reshape(-1, dims)


def _slices(batch: pa.RecordBatch, dims: int, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, integers) of a batch with a list column ``vector``, a bounded number of components at a time."""
    step = max(1, SLICE // dims)
    for at in range(0, batch.num_rows, step):
        yield at, integers(batch.column("vector").slice(at, step).flatten().to_numpy(zero_copy_only=False), dims, scale)


def _fit(ints: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Both as 64-bit numbers, or both as Python's where either needs them."""
    fast = ints.dtype != object and all(np.abs(b).max(initial=0) < FAST for b in books)
    kind = np.int64 if fast else object
    return ints.astype(kind), [b.astype(kind) for b in books]


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, vector, label) of rows with an id whose vector is all finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    return d.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite))


def first_books(kept: DataFrame, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    """Codebooks of the vectors with the least ids (distinct; of rows that share one, the least vector)."""
    least = kept.groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").limit(entries).collect()
    if not least:
        return []
    dims = len(least[0]["vector"])
    if dims == 0 or dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    flat = np.array([x for r in least if len(r["vector"]) == dims for x in r["vector"]], np.float64)
    ints = integers(flat, dims, scale)
    return [ints[:, p * dims // parts : (p + 1) * dims // parts] for p in range(parts)]


def _digits(total: int) -> list[int]:
    """total in digits of DIGIT bits, lowest first; the last has the sign."""
    out = []
    while not -(1 << DIGIT) < total < 1 << DIGIT:
        out.append(total & ((1 << DIGIT) - 1))
        total >>= DIGIT
    return [*out, total]


def _sums(vectors: DataFrame, books: list[np.ndarray], scale: int) -> DataFrame:
    """(part, entry, position, digit, total, n): sums of the parts that go to each entry, a row a digit and task at most."""
    dims = sum(b.shape[1] for b in books)

    def run(batches):
        totals = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for _, ints in _slices(batch, dims, scale):
                ints, own = _fit(ints, books)
                for p, book in enumerate(own):
                    x = ints[:, p * book.shape[1] : (p + 1) * book.shape[1]]
                    code, _ = nearest(x, book)
                    counts[p] += np.bincount(code, minlength=len(book))
                    by = np.argsort(code, kind="stable")
                    seen, starts = np.unique(code[by], return_index=True)
                    if len(seen):
                        totals[p][seen] += np.add.reduceat(x[by], starts, axis=0)
        rows = [(p, k, j, d, t, int(counts[p][k])) for p, b in enumerate(books) for k in range(len(b)) if counts[p][k] for j in range(b.shape[1]) for d, t in enumerate(_digits(int(totals[p][k, j])))]
        cols = zip(*rows, strict=True) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32()] * 4 + [pa.int64()] * 2, strict=True)], names=["part", "entry", "position", "digit", "total", "n"])

    sums = vectors.select("vector").mapInArrow(run, "part int, entry int, position int, digit int, total long, n long")
    return sums.groupBy("part", "entry", "position", "digit").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def refined(vectors: DataFrame, books: list[np.ndarray], scale: int) -> list[np.ndarray]:
    """Codebooks after one round over all vectors."""
    out, totals, counts = [b.astype(object) for b in books], Counter(), {}
    for r in _sums(vectors, books, scale).collect():  # parts x entries x positions rows, of a digit or two
        key = (r["part"], r["entry"], r["position"])
        totals[key] += r["total"] << DIGIT * r["digit"]
        if r["digit"] == 0:  # every task has this one
            counts[key] = r["n"]
    for (p, k, j), total in totals.items():
        out[p][k, j] = total // counts[p, k, j]
    return out


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for row in b for x in row).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], scale: int) -> DataFrame:
    """(id, label, code, error) of each vector; code has two hex digits for each part."""
    dims = sum(b.shape[1] for b in books)
    pair = [f"{k:02x}" for k in range(256)]

    def run(batches):
        for batch in batches:
            codes, errors = [], []
            for _, ints in _slices(batch, dims, scale):
                ints, own = _fit(ints, books)
                found, error = [], np.zeros(len(ints), ints.dtype)
                for p, book in enumerate(own):
                    code, distance = nearest(ints[:, p * book.shape[1] : (p + 1) * book.shape[1]], book)
                    found.append(code)
                    error += distance
                codes += ["".join(map(pair.__getitem__, row)) for row in np.stack(found, axis=1).tolist()]
                errors += [e if e < 1 << 63 else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(run, f"id long, label {kind}, code string, error long")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """One row per kept row of vectors: id, label, code, error (squared distances of all parts), label_error (error
    summed over the rows with that label, null ones together) and books_sha256 (of the final codebooks).

    Rows with a null id, a null vector or a component that is null or no finite number are left out, and so are vectors
    of another length than that of the least kept id, which no codebook fits; a length that parts do not divide is
    a ValueError.  Repeated rows are coded as often as they occur.  With fewer ids than entries the codebooks are
    smaller.  An empty table gives an empty result.  Integers of any size are compared exactly; an error beyond 64
    bits is null, as is its label's sum."""
    if not 1 <= entries <= 256:
        raise ValueError("an index is one byte: entries must be from 1 to 256")
    kept = _kept(vectors, id_col, vector_col, label_col)
    books = first_books(kept, parts, entries, scale)
    if not books:
        return kept.limit(0).select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("books_sha256"))
    kept = kept.where(F.size("vector") == sum(b.shape[1] for b in books))
    for _ in range(rounds):
        books = refined(kept, books, scale)
    coded = stored(encode(kept, books, scale), "vector-codes", True)
    return _with_label_error(coded).withColumn("books_sha256", F.lit(books_digest(books)))


def _with_label_error(coded: DataFrame) -> DataFrame:
    """Rows meet their label's sum on one of SALT copies of it, so a label with a third of all rows is no hot task."""
    total = F.sum(F.col("error").cast(WIDE))
    sums = coded.groupBy("label").agg(F.when(F.count("error") == F.count(F.lit(1)), F.when(total < F.lit(str(1 << 63)).cast(WIDE), total.cast("long"))).alias("label_error"))
    copies = sums.select(F.col("label").alias("of_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("of_salt"))
    salt: Column = F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")
    return coded.join(copies, coded["label"].eqNullSafe(copies["of_label"]) & (salt == copies["of_salt"])).select("id", "label", "code", "error", "label_error")
