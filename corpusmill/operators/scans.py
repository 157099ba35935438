"""Recursions along sequences of any length, spread over partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import pinned


def compose(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For maps x -> a x + b in order of application, (a, b) of each with all before it, by doubling steps."""
    a, b, step = a.astype(np.float64), b.astype(np.float64), 1
    while step < len(a):
        b[step:] = a[step:] * b[:-step] + b[step:]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return a, b


def _runs(batches, after: dict[int, float] | None):
    """Per batch of a partition's rows, last first: (batch, a, b, following, sequences): each row's map composed with those
    of the rows after it, and the b of the next row.

    after: by partition, the value that its last sequence takes over; None for the composed maps alone."""
    carry_a, carry_b, last = 1.0, 0.0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        seq = np.array(batch.column("_seq").to_pylist(), dtype=object)
        a, b = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("_a", "_b"))
        fresh = np.concatenate(([last is None or seq[0] != last[0]], seq[1:] != seq[:-1]))
        if last is None:
            part = batch.column("_part")[0].as_py()
            carry_a, carry_b = (1.0, 0.0) if after is None else (0.0, after.get(part, 0.0))
            fresh[0] = False
        b[0] += 0.0 if fresh[0] else a[0] * carry_b
        a[0] = 0.0 if fresh[0] else a[0] * carry_a
        a[1:][fresh[1:]] = 0.0
        a, b = compose(a, b)
        following = np.where(fresh, 0.0, np.concatenate(([carry_b], b[:-1])))
        carry_a, carry_b, last = a[-1], b[-1], (seq[-1],)
        yield batch, a, b, following, seq


def reverse_scan(df: DataFrame, sequence: str, order: str, factor: str, term: str, name: str = "value") -> DataFrame:
    """W9 for sequences of any length: value = term + factor * (value of the next row by order), the term alone at a sequence's end;
    and the next row's value as {name}_next, 0 at the end.

    Rows are dealt by range of (sequence, order), so a sequence may lie across partitions.  Each partition composes its
    rows' maps x -> factor x + term; what its first sequence does to a value from later partitions is one row a
    partition, folded on the driver from the last partition to the first; then each partition works out its own
    values.  Orders within a sequence should differ; ties come in any order.  Null factors and terms are 0; a null
    sequence is one of its own."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumns({"_seq": F.col(sequence).cast("string"), "_a": F.coalesce(F.col(factor).cast("double"), F.lit(0.0)), "_b": F.coalesce(F.col(term).cast("double"), F.lit(0.0))})
    d = d.repartitionByRange(n, "_seq", order).sortWithinPartitions(F.desc("_seq"), F.desc(order)).withColumn("_part", F.spark_partition_id())
    d = pinned(d)

    def ends(batches):
        top = bottom = None
        for batch, a, b, _, seq in _runs(batches, None):
            top = (seq[0], batch.column("_part")[0].as_py()) if top is None else top
            bottom = (seq[-1], float(a[-1]), float(b[-1]))
        if top is not None:
            yield pa.RecordBatch.from_pydict({"part": [top[1]], "top": pa.array([top[0]], pa.string()), "bottom": pa.array([bottom[0]], pa.string()), "a": [bottom[1]], "b": [bottom[2]]}, schema=pa.schema([("part", pa.int32()), ("top", pa.string()), ("bottom", pa.string()), ("a", pa.float64()), ("b", pa.float64())]))

    rows = d.select("_part", "_seq", "_a", "_b").mapInArrow(ends, "part int, top string, bottom string, a double, b double").collect()  # a row per partition
    after: dict[int, float] = {}
    later = None  # (sequence at the lower end, its value) of the next partition
    for r in sorted(rows, key=lambda r: -r["part"]):
        taken = later[1] if later is not None and later[0] == r["top"] else 0.0
        after[r["part"]] = taken
        later = (r["bottom"], r["b"] + r["a"] * taken)
    fields = [c for c in d.columns if c not in ("_seq", "_a", "_b", "_part")]

    def values(batches):
        for batch, _, b, following, _ in _runs(batches, after):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), pa.array(b, pa.float64()), pa.array(following, pa.float64())], names=[*fields, name, f"{name}_next"])

    schema = df.select(*[F.col(f"`{c}`") for c in fields]).schema.add(name, "double").add(f"{name}_next", "double")
    return d.mapInArrow(values, schema)


def long_advantages(df: DataFrame, sequence: str, step: str, reward: str, value: str, gamma: float, lam: float, name: str = "advantage") -> DataFrame:
    """Generalised advantages of sequences of any length, a row a step.

    A_t = r_t - v_t + E_t, where E_t = gamma v_{t+1} + gamma lam A_{t+1} is what the following row passes on.  With
    X_t = E_{t-1} this is X_t = gamma v_t + gamma lam (r_t - v_t) + gamma lam X_{t+1}: one scan, whose next values are E."""
    r, v = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (reward, value))
    d = df.withColumns({"_factor": F.lit(gamma * lam), "_term": gamma * v + gamma * lam * (r - v)})
    d = reverse_scan(d, sequence, step, "_factor", "_term", "_x")
    return d.withColumn(name, r - v + F.col("_x_next")).drop("_factor", "_term", "_x", "_x_next")
