"""Where models and tokenizers plug in: Arrow batches in, Arrow batches out."""

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_tokens(df: DataFrame, text_col: str, make_tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]], name: str = "input_ids") -> DataFrame:
    """B1: ids of a caller's tokenizer, made once a worker; null text has no ids."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_tokenizer()
        for s in batches:
            yield pd.Series(encode([x or "" for x in s]))

    return df.withColumn(name, run(F.col(text_col)))


def generate(df: DataFrame, make_engine: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """A rollout engine, made once a task, over batches of prompts; its rows have the schema."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        engine = make_engine()
        for b in batches:
            yield engine(b)

    return df.mapInPandas(run, schema)


def refuse_long(df: DataFrame, ids: str, budget: int) -> DataFrame:
    """B2: an error, not a cut, where a row is over its budget."""
    n = F.size(ids)
    ok = F.when(n <= budget, F.lit(True)).otherwise(F.raise_error(F.format_string("%d tokens over the budget of %d", n, F.lit(budget))).cast("boolean"))
    return df.where(ok)
