"""Training rows of conversations and texts: ids, labels and masks by a caller's tokenizer.

Texts are rendered by column expressions; one Arrow pass encodes them and aligns the answers' character spans
with the tokens' offsets.  A token is supervised if it lies within an answer, from after an opening marker through the
next closing one; a token that began before the span is not.  Spans come from the rendered text alone, so nothing
depends on how the markers are cut into ids.

A tokenizer is a file of the ``tokenizers`` library and the strings of its marks; marks that the vocabulary lacks
are added to it as special tokens, with the ids after its last.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chat
from ..functions.text import text


@dataclass(frozen=True)
class Tokens:
    """A tokenizer file, and the strings of its opening, closing and padding marks."""

    path: str
    start: str = chat.START
    end: str = chat.END
    pad: str = "<|endoftext|>"

    def load(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        out.add_special_tokens([x for x in (self.start, self.end, self.pad) if out.token_to_id(x) is None])
        return out


def answer_spans(rendered: str, opening: str, closing: str) -> list[tuple[int, int]]:
    """Characters from after each opening through the next closing; to the end where none follows."""
    spans, at = [], rendered.find(opening)
    while at >= 0:
        begin = at + len(opening)
        end = rendered.find(closing, begin)
        stop = len(rendered) if end < 0 else end + len(closing)
        spans.append((begin, stop))
        at = rendered.find(opening, stop)
    return spans


def supervised(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens, by their (first, last) characters, lie within a span; spans are in order and apart."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), bool)
    begin, stop = np.array(spans).T
    k = np.searchsorted(begin, offsets[:, 0], side="right") - 1
    return (k >= 0) & (offsets[:, 1] <= stop[np.maximum(k, 0)]) & (offsets[:, 1] > offsets[:, 0])


def _fixed(ids: np.ndarray, length: int, filler: int) -> np.ndarray:
    return np.concatenate([ids[:length], np.full(max(0, length - len(ids)), filler, np.int32)]).astype(np.int32)


def _frame(columns: dict[str, list]) -> pd.DataFrame:
    return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in columns.items()})


#: Texts, and characters of them beyond the first text, that are encoded at a time: a token takes some 100 bytes before it is an id.
ENCODED_ROWS, ENCODED_CHARS = 64, 200_000


def few_at_a_time(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Texts in order, in lists of bounded size; null is empty."""
    out, chars = [], 0
    for x in texts:
        x = x or ""
        if out and (len(out) == ENCODED_ROWS or chars + len(x) > ENCODED_CHARS):
            yield out
            out, chars = [], 0
        out.append(x)
        chars += len(x)
    if out:
        yield out


def chat_rows(rendered: Column, tokens: Tokens, length: int) -> Column:
    """B1: struct(input_ids, mask) of a rendered conversation: cut and padded to length; mask is 1 on answers."""

    @F.pandas_udf("input_ids array<int>, mask array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = tokens.load()
        pad, opening, closing = t.token_to_id(tokens.pad), tokens.start + "assistant\n", tokens.end + "\n"
        for texts in (t for s in batches for t in few_at_a_time(s)):
            out = {"input_ids": [], "mask": []}
            for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
                mask = supervised(np.array(e.offsets, np.int64).reshape(-1, 2), answer_spans(x, opening, closing))
                out["input_ids"].append(_fixed(np.array(e.ids, np.int32), length, pad))
                out["mask"].append(_fixed(mask.astype(np.int32), length, 0))
            yield _frame(out)

    return run(rendered)


def pretraining_rows(df: DataFrame, text_col: str, tokens: Tokens, length: int = 512) -> DataFrame:
    """B1 for plain texts: input_ids, the text's ids between the opening and the closing mark, cut so that both stay and
    padded to length; labels, the same with IGNORE on every padding id.  A null text is an empty one."""
    if length < 2:
        raise ValueError("both marks must fit")

    @F.pandas_udf("input_ids array<int>, labels array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = tokens.load()
        pad, first, last = (t.token_to_id(x) for x in (tokens.pad, tokens.start, tokens.end))
        for texts in (t for s in batches for t in few_at_a_time(s)):
            out = {"input_ids": [], "labels": []}
            for e in t.encode_batch(texts, add_special_tokens=False):
                ids = _fixed(np.array([first, *e.ids[: length - 2], last], np.int32), length, pad)
                out["input_ids"].append(ids)
                out["labels"].append(np.where(ids == pad, chat.IGNORE, ids).astype(np.int32))
            yield _frame(out)

    return df.withColumn("_row", run(F.col(text_col))).select(*df.columns, "_row.*")


def finetuning_rows(df: DataFrame, key: str, messages: str, tokens: Tokens, length: int = 1024, *, tools: str | None = None, full: bool = False, prompts: list[str] | None = None, share: float = 0.2, kept_think: float | None = 0.2, seed: int = 0) -> DataFrame:
    """B1 for supervised conversations: input_ids and labels, IGNORE outside the answers.

    prompts: system turns that share of the conversations without one or declared tools get; None adds none.
    kept_think: share of the texts that keep empty thoughts; None keeps all.  Draws are by the key's hash.
    tools: a column of declared tools (a JSON list or null).  full: messages carry calls and thoughts."""
    m, declared = F.col(messages), F.col(tools) if tools else F.lit(None).cast("string")
    if prompts:
        m = F.when(text(declared) != "", m).otherwise(chat.add_system_prompt(m, F.col(key), prompts, share, seed))
    rendered = chat.render_with_tools(m, declared, full=full) if tools else chat.render(m, full=full)
    if kept_think is not None:
        rendered = chat.drop_empty_think(rendered, F.col(key), kept_think, seed)
    d = df.withColumn("_row", chat_rows(rendered, tokens, length)).select(*df.columns, "_row.*")
    return d.withColumn("labels", F.zip_with("input_ids", "mask", lambda i, m: F.when(m == 1, i).otherwise(F.lit(chat.IGNORE)))).drop("mask")


def preference_rows(df: DataFrame, key: str, chosen: str, rejected: str, tokens: Tokens, length: int = 4096, *, kept_think: float | None = 0.2, seed: int = 0) -> DataFrame:
    """B1 for preferences: x, y and mask of the chosen and of the rejected conversation: ids without the last, ids
    without the first, and which of the latter belong to answers."""
    out = df
    for k, (name, column) in enumerate((("chosen", chosen), ("rejected", rejected))):
        rendered = chat.render(F.col(column))
        if kept_think is not None:
            rendered = chat.drop_empty_think(rendered, F.col(key), kept_think, seed + k)
        out = out.withColumn(f"_{name}", chat_rows(rendered, tokens, length))
    parts = []
    for name in ("chosen", "rejected"):
        pair = chat.shifted(F.col(f"_{name}.input_ids"))
        parts += [pair["x"].alias(f"x_{name}"), pair["y"].alias(f"y_{name}"), chat.shifted(F.col(f"_{name}.mask"))["y"].alias(f"mask_{name}")]
    return out.select(*df.columns, *parts)


def rollout_prompts(df: DataFrame, key: str, messages: str, *, prompts: list[str] | None = None, share: float = 0.2, thinking: float = 0.5, seed: int = 0) -> DataFrame:
    """B1 for rewarded rollouts: prompt, all turns but the last with the opening of an answer, and an empty answer.  A
    share of thinking of the openings leave the thoughts open."""
    m = chat.add_system_prompt(F.col(messages), F.col(key), prompts, share, seed) if prompts else F.col(messages)
    m = chat.hold_out_last(m)
    opened = chat.unit(F.col(key), seed + 2) < thinking
    prompt = F.when(opened, chat.render(m, generation_prompt=True, open_thinking=True)).otherwise(chat.render(m, generation_prompt=True))
    return df.select(*df.columns, prompt.alias("prompt"), F.lit("").alias("answer"))


def agent_rows(df: DataFrame, messages: str, tools: str, truths: str) -> DataFrame:
    """B1 for agents: the turns but the last, the tools of the last system turn that declares some (null if none does),
    and the truths to be verified.  Turns have a field for their tools."""
    stated = F.filter(F.col(messages), lambda m: (m["role"] == "system") & (text(m[tools]) != ""))
    last = F.try_element_at(stated, F.lit(-1))[tools]
    rest = [c for c in df.columns if c not in (messages, truths)]
    return df.select(*rest, chat.hold_out_last(F.col(messages)).alias("messages"), last.alias("tools"), F.col(truths).alias("gt"))
