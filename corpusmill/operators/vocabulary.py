"""Counts of a corpus by a given vocabulary: words, the pairs that each merge finds, and the pieces that are left.

Nothing is trained: the merges are those of a tokenizer file, in its order.  The corpus comes down to a table of
distinct words with their counts first; words are dealt to tasks, and a task goes through the merges in order, with an
index from pairs to its words.  A merge touches only the words that hold its pair, whose pairs are entered anew; so
the counts follow the corpus from merge to merge without another look at the rest.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def word_counts(df: DataFrame, text_col: str, path: str) -> DataFrame:
    """(word, n): how often the pre-tokenizer of a tokenizer file finds each word in the texts; null is empty.  A task
    counts a batch before it gives its words to the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        for b in batches:
            seen: Counter[str] = Counter()
            for text in b.column(0).to_pylist():
                if text:
                    plain = t.normalizer.normalize_str(text) if t.normalizer else text
                    seen.update(w for w, _ in t.pre_tokenizer.pre_tokenize_str(plain))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return df.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def merges_of(path: str) -> list[tuple[str, str]]:
    """The merges of a tokenizer file of the byte-pair kind."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["model"]["merges"]
    return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in found]


class Words:
    """Words as symbols, with an index from each neighbouring pair to the words that may hold it."""

    def __init__(self, rows: Iterator[tuple[str, int]]):
        self.symbols, self.counts, self.holders = [], [], defaultdict(set)
        for word, n in rows:
            self.symbols.append(list(word))
            self.counts.append(n)
            self._enter(len(self.symbols) - 1)

    def _enter(self, k: int) -> None:
        for pair in zip(self.symbols[k], self.symbols[k][1:], strict=False):
            self.holders[pair].add(k)

    def merge(self, left: str, right: str) -> tuple[int, int]:
        """(neighbouring pairs, merges made, left to right) over all words, by their counts."""
        pairs = made = 0
        for k in self.holders.pop((left, right), ()):
            old, new, i = self.symbols[k], [], 0
            pairs += self.counts[k] * sum(a == left and b == right for a, b in zip(old, old[1:], strict=False))
            while i < len(old):
                if old[i] == left and i + 1 < len(old) and old[i + 1] == right:
                    new.append(left + right)
                    i += 2
                else:
                    new.append(old[i])
                    i += 1
            made += self.counts[k] * (len(old) - len(new))
            self.symbols[k] = new
            self._enter(k)
        return pairs, made


def _dealt(words: DataFrame) -> DataFrame:
    return words.select("word", "n").repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


def merge_counts(words: DataFrame, path: str, merges: int | None = None) -> DataFrame:
    """(rank, left, right, n_pairs, n_merged) of the first merges: neighbouring pairs there are when a merge's turn comes, and
    how many it joins (fewer where they overlap); merges that find none are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = Words(_rows(batches)), []
        for rank, (left, right) in enumerate(merges_of(path)[:merges]):
            pairs, made = own.merge(left, right)
            if pairs:
                out.append((rank, left, right, pairs, made))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["rank", "left", "right", "n_pairs", "n_merged"])

    found = _dealt(words).mapInArrow(run, "rank int, left string, right string, n_pairs long, n_merged long")
    return found.groupBy("rank", "left", "right").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("n_merged").alias("n_merged"))


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """(piece, n) of the pieces that all merges leave, over the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Words(_rows(batches)), Counter()
        for left, right in merges_of(path):
            own.merge(left, right)
        for symbols, n in zip(own.symbols, own.counts, strict=True):
            for x in symbols:
                seen[x] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])

    return _dealt(words).mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
