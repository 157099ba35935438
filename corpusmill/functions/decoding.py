"""The choice of a next token from an array of scores: penalties, cuts, and a seeded draw.

Scores are ARRAY<DOUBLE> by token id.  The rules follow one another as arrays of one row, in Arrow batches; no
model runs here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def adjusted(scores: np.ndarray, seen: np.ndarray, banned: np.ndarray, temperature: float, penalty: float) -> np.ndarray:
    """Scores over the temperature; those of seen tokens moved away from choice by the penalty; banned ones impossible."""
    out = scores / temperature
    seen = np.unique(seen[(seen >= 0) & (seen < len(out))])
    out[seen] = np.where(out[seen] > 0, out[seen] / penalty, out[seen] * penalty)
    out[banned[(banned >= 0) & (banned < len(out))]] = -np.inf
    return out


def probabilities(scores: np.ndarray, top_k: int, top_p: float) -> np.ndarray:
    """Softmax of what both cuts leave: the top_k best scores with all that tie with the last of them, and of
    these the best ones up to the one with which their mass first exceeds top_p, ties to the lower id."""
    if not np.isfinite(scores).any():
        return np.zeros(len(scores))
    e = np.exp(scores - scores.max())
    if 0 < top_k < len(e):
        e[scores < np.partition(scores, -top_k)[-top_k]] = 0.0
    if top_p < 1.0:
        order = np.argsort(-e, kind="stable")
        mass = np.cumsum(e[order]) / e.sum()
        e[order[1:][mass[:-1] > top_p]] = 0.0
    return e / e.sum()


def choose_token(scores: Column, seen: Column, banned: Column, draw: Column, *, temperature: float = 0.85, top_k: int = 50, top_p: float = 0.85, penalty: float = 1.0, greedy: bool = False) -> Column:
    """struct(token, probability, candidates).

    scores are divided by temperature; a seen token's score is divided by penalty if positive, else multiplied; banned
    tokens go; then the cuts (top_k 0 and top_p 1 cut nothing).  draw from [0, 1), such as chat.unit() gives, picks by
    cumulative probability in the order of ids; greedy takes the likeliest, ties to the lower id.  Null
    arrays are empty, null scores impossible; without a possible token all is null."""
    if temperature <= 0 or penalty <= 0:
        raise ValueError("temperature and penalty must be positive")

    @F.pandas_udf("token int, probability double, candidates int")
    def run(scores: pd.Series, seen: pd.Series, banned: pd.Series, draw: pd.Series) -> pd.DataFrame:
        ids = lambda x: np.array([], np.int64) if x is None else np.array([int(i) for i in x if i is not None], np.int64)
        rows = []
        for s, own, no, u in zip(scores, seen, banned, draw, strict=True):
            s = np.array([] if s is None else s, np.float64)
            p = probabilities(adjusted(np.where(np.isnan(s), -np.inf, s), ids(own), ids(no), temperature, penalty), top_k, top_p)
            if not p.any():
                rows.append((None, None, None))
                continue
            token = int(np.argmax(p)) if greedy else min(int(np.searchsorted(np.cumsum(p), u, side="right")), int(np.flatnonzero(p)[-1]))
            rows.append((token, p[token], int(np.count_nonzero(p))))
        out = pd.DataFrame(rows, columns=["token", "probability", "candidates"])
        return out.astype({"token": "Int32", "probability": "Float64", "candidates": "Int32"})

    return run(scores, seen, banned, draw)


def finished_after(tokens: Column, end_id: int) -> Column:
    """A row's tokens with the end token in every place after its first one."""
    first = F.array_position(tokens, F.lit(end_id).cast("int"))
    return F.transform(tokens, lambda x, i: F.when((first > 0) & (i >= first), F.lit(end_id).cast("int")).otherwise(x))
