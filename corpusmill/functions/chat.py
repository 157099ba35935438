"""Conversations: structure, templates, responses, supervision masks.

A conversation is ARRAY<STRUCT<role, content, ...>>; long tables (conv_id, turn, role, text) are
gathered with ``gather_turns``.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WS, strip, text

# The template's strings.  Fixed values.
START, END = "<|im_start|>", "<|im_end|>"
EMPTY_THINK = "<think>\n\n</think>\n\n"
TOOLS_BEFORE = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
TOOLS_AFTER = "\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{\"name\": <function-name>, \"arguments\": <args-json-object>}\n</tool_call>"
IGNORE = -100


def unit(key: Column, seed: int) -> Column:
    """A draw from [0, 1) by md5 of seed and key, which any engine gives alike."""
    hexed = F.substr(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), F.lit(1), F.lit(8))
    return F.conv(hexed, 16, 10).cast("long") / F.lit(4294967296.0)


def gather_turns(long: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", extra: list[str] | None = None) -> DataFrame:
    """conv_id, messages: turns in order, with the extra columns; one conversation is one row, so its turns are bounded by it."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), text(content).alias("content"), *(extra or []))))
    return long.groupBy(F.col(conv).alias("conv_id")).agg(parts.alias("messages"))


def valid_structure(messages: Column, least_answer: int = 5) -> Column:
    """at least two turns, user first, then an assistant whose answer has least_answer characters."""
    first, second = F.get(messages, F.lit(0)), F.get(messages, F.lit(1))
    ok = (F.size(messages) >= 2) & (first["role"] == "user") & (second["role"] == "assistant") & (strip(first["content"]) != "") & (F.length(strip(second["content"])) >= least_answer)
    return F.coalesce(ok, F.lit(False))


def last_query_index(messages: Column) -> Column:
    """Place of the last user turn that is no tool response; the last turn if there is none."""
    hits = F.transform(messages, lambda m, i: F.when((m["role"] == "user") & ~(F.startswith(m["content"], F.lit("<tool_response>")) & F.endswith(m["content"], F.lit("</tool_response>"))), i))
    return F.coalesce(F.array_max(F.filter(hits, lambda x: x.isNotNull())), F.size(messages) - 1)


def _between(c: Column, sign: str = "\n") -> Column:
    return F.regexp_replace(c, f"^[{sign}]+|[{sign}]+$", "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _calls(calls: pd.Series) -> pd.Series:
    """The calls of each turn (a JSON list or null) as the template writes them; arguments that are no string are JSON."""

    def turn(raw: str | None) -> str:
        found = [c.get("function") or c for c in (json.loads(raw) if raw else [])]
        args = lambda a: a if isinstance(a, str) else json.dumps(a, ensure_ascii=False)
        return "\n".join(f'<tool_call>\n{{"name": "{c["name"]}", "arguments": {args(c.get("arguments"))}}}\n</tool_call>' for c in found)

    return calls.map(lambda xs: [turn(x) for x in xs])


def render(messages: Column, generation_prompt: bool = False, open_thinking: bool = False, full: bool = False) -> Column:
    """The chat template for system, user, assistant and tool turns without declared tools.

    Assistant turns carry their thoughts in think tags; neighbouring tool turns share one user block.
    full: messages also have reasoning_content (thoughts beside the content, which is left whole then)
    and tool_calls (a JSON list)."""
    roles = F.transform(messages, lambda m: m["role"])
    if full:  # a Python function can't stand within a lambda
        calls = _calls(F.transform(messages, lambda m: m["tool_calls"]))
        messages = F.zip_with(messages, calls, lambda m, c: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["reasoning_content"].alias("beside"), c.alias("called")))

    def turn(m: Column, i: Column) -> Column:
        role, content = m["role"], text(m["content"])
        has = F.contains(content, F.lit("</think>"))
        # thoughts: what stands after the last opening tag of what stands before the first closing one
        before = F.regexp_replace(F.substring_index(content, "</think>", 1), "\n+$", "")
        thoughts = F.when(has, F.regexp_replace(F.substring_index(before, "<think>", -1), "^\n+", "")).otherwise("")
        answer = F.when(has, F.regexp_replace(F.substring_index(content, "</think>", -1), "^\n+", "")).otherwise(content)
        called = F.lit("")
        if full:
            beside, said = m["beside"], m["called"]
            thoughts, answer = F.coalesce(beside, thoughts), F.when(beside.isNull(), answer).otherwise(content)
            called = F.when(said == "", F.lit("")).otherwise(F.concat(F.when(answer == "", F.lit("")).otherwise(F.lit("\n")), said))
        plain = F.concat(F.lit(START), role, F.lit("\n"), content, F.lit(END + "\n"))
        assistant = F.concat(F.lit(START + "assistant\n<think>\n"), _between(thoughts), F.lit("\n</think>\n\n"), F.regexp_replace(answer, "^\n+", ""), called, F.lit(END + "\n"))
        other = lambda k: F.coalesce(F.get(roles, k) != "tool", F.lit(True))
        tool = F.concat(F.when(other(i - 1), F.lit(START + "user")).otherwise(""), F.lit("\n<tool_response>\n"), content, F.lit("\n</tool_response>"), F.when(other(i + 1), F.lit(END + "\n")).otherwise(""))
        return F.when(role.isin("user", "system"), plain).when(role == "assistant", assistant).when(role == "tool", tool).otherwise("")

    out = F.array_join(F.transform(messages, turn), "")
    if generation_prompt:
        out = F.concat(out, F.lit(START + "assistant\n" + ("<think>\n" if open_thinking else EMPTY_THINK)))
    return out


@F.pandas_udf(T.StringType())
def _tools_header(tools: pd.Series, system: pd.Series) -> pd.Series:
    def one(t: str | None, s: str | None) -> str | None:
        if not t:
            return None
        lines = "".join("\n" + json.dumps(x, ensure_ascii=False) for x in json.loads(t))
        return START + "system\n" + ("" if s is None else s + "\n\n") + TOOLS_BEFORE + lines + TOOLS_AFTER + END + "\n"

    return pd.Series([one(t, s) for t, s in zip(tools, system, strict=True)], dtype=object)


def render_with_tools(messages: Column, tools: Column, generation_prompt: bool = False, open_thinking: bool = False, full: bool = False) -> Column:
    """X29 with declared tools (a JSON list): their header takes in a leading system turn.  The other arguments are
    those of render(): the turns' calls and thoughts, and the opening of the answer that is to come."""
    first = F.get(messages, F.lit(0))
    system = F.when(first["role"] == "system", text(first["content"]))
    rest = F.when(first["role"] == "system", F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    declared = text(tools) != ""
    turns = render(F.when(declared, rest).otherwise(messages), generation_prompt, open_thinking, full)
    return F.when(declared, F.concat(_tools_header(tools, system), turns)).otherwise(turns)


def add_system_prompt(messages: Column, key: Column, prompts: list[str], share: float = 0.2, seed: int = 0) -> Column:
    """A system turn, drawn by the key's hash, before share of the conversations that have none."""
    draw = unit(key, seed)
    prompt = F.element_at(F.array(*map(F.lit, prompts)), (F.floor(unit(key, seed + 1) * len(prompts)) + 1).cast("int"))
    none = F.get(messages, F.lit(0))["role"] != "system"
    turn = F.named_struct(F.lit("turn"), F.lit(-1).cast("long"), F.lit("role"), F.lit("system"), F.lit("content"), prompt)
    return F.when(none & (draw < share), F.concat(F.array(turn), messages)).otherwise(messages)


def drop_empty_think(rendered: Column, key: Column, kept: float = 0.2, seed: int = 0) -> Column:
    """Empty thoughts leave all but kept of the texts, drawn by the key's hash."""
    return F.when(unit(key, seed) > kept, F.replace(rendered, F.lit(EMPTY_THINK), F.lit(""))).otherwise(rendered)


_CALL = r"(?s)<tool_call>(.*?)</tool_call>"


def parse_tool_calls(c: Column | str) -> Column:
    """ARRAY<STRUCT<name, arguments>> of the calls that are JSON; arguments stay JSON text."""
    raw = F.transform(F.regexp_extract_all(text(c), F.lit(_CALL), F.lit(1)), strip)
    good = F.filter(raw, lambda x: F.get_json_object(x, "$").isNotNull() & x.rlike(r"(?s)^\{.*\}$"))
    return F.transform(good, lambda x: F.struct(F.get_json_object(x, "$.name").alias("name"), F.coalesce(F.get_json_object(x, "$.arguments"), F.lit("{}")).alias("arguments")))


def parse_response(c: Column | str) -> Column:
    """struct(content, reasoning, tool_calls) of a model's text."""
    t = text(c)
    closed = t.rlike("(?s)<think>.*?</think>")
    half = F.contains(t, F.lit("</think>"))
    reasoning = F.when(closed, strip(F.regexp_extract(t, "(?s)<think>(.*?)</think>", 1))).when(half, strip(F.substring_index(t, "</think>", 1)))
    after = F.substr(t, F.instr(t, "</think>") + len("</think>"))
    rest = F.when(closed, F.regexp_replace(t, rf"(?s)<think>.*?</think>[{WS}]*", "")).when(half, strip(after)).otherwise(t)
    calls = parse_tool_calls(rest)
    content = strip(F.when(F.size(calls) > 0, F.regexp_replace(rest, _CALL, "")).otherwise(rest))
    return F.struct(content.alias("content"), reasoning.alias("reasoning"), calls.alias("tool_calls"))


def pad(ids: Column, length: int, filler: int) -> Column:
    """Cut to length, then filled up to it."""
    kept = F.slice(ids, 1, length)
    return F.concat(kept, F.array_repeat(F.lit(filler).cast("int"), F.lit(length) - F.size(kept)))


def supervision_mask(ids: Column, begin: list[int], end: list[int], max_length: int) -> Column:
    """Ids from after each begin marker through the next end marker, IGNORE elsewhere; a span that
    nothing ends goes to the end.

    The markers' places are found first; one pass over these pairs them, as a marker may lie within
    another or within a span; the mask asks which spans hold a position."""
    ids = F.coalesce(ids, F.array().cast("array<int>"))
    at = lambda m, i: F.slice(ids, i + 1, F.lit(len(m))) == F.array(*map(F.lit, m))
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0))), lambda i: at(begin, i) | at(end, i))
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    # start: of the open span, or -1; free: the first position that no marker has used
    start = F.struct(F.lit(-1).alias("start"), F.lit(0).alias("free"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def step(s: Column, i: Column) -> Column:
        opens = (s["start"] < 0) & at(begin, i) & (i >= s["free"])
        closes = (s["start"] >= 0) & at(end, i) & (i >= s["start"])
        first, last = (i + len(begin)).cast("int"), (i + len(end)).cast("int")
        return F.struct(
            F.when(opens, first).when(closes, F.lit(-1)).otherwise(s["start"]).alias("start"), F.when(opens, first).when(closes, last).otherwise(s["free"]).alias("free"),
            F.when(closes, F.concat(s["spans"], F.array(span(s["start"], last)))).otherwise(s["spans"]).alias("spans"),
        )

    spans = F.aggregate(places, start, step, lambda s: F.when(s["start"] >= 0, F.concat(s["spans"], F.array(span(s["start"], F.size(ids))))).otherwise(s["spans"]))
    return F.transform(ids, lambda x, i: F.when((i < max_length) & F.exists(spans, lambda p: (p["a"] <= i) & (i < p["b"])), x).otherwise(F.lit(IGNORE)))


def valid_labels(labels: Column) -> Column:
    """labels that count."""
    return F.filter(labels, lambda x: x != IGNORE)


def shifted(ids: Column) -> Column:
    """struct(x, y): all but the last, all but the first."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.struct(F.slice(ids, F.lit(1), n).alias("x"), F.slice(ids, F.lit(2), n).alias("y"))


def banned_tokens(ids: Column, n: int) -> Column:
    """Tokens that would repeat an n-gram of ids, sorted; none for n under 1."""
    if n < 1:
        return F.array().cast("array<int>")
    size = F.size(ids)
    tail = F.slice(ids, F.greatest(size - n + 2, F.lit(1)), F.lit(n - 1)) if n > 1 else F.array().cast("array<int>")
    hits = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.when((F.slice(ids, i + 1, F.lit(n - 1)) == tail) if n > 1 else F.lit(True), F.get(ids, i + n - 1)))
    return F.when(size >= n, F.array_sort(F.array_distinct(F.filter(hits, lambda x: x.isNotNull())))).otherwise(F.array().cast("array<int>"))


def hold_out_last(messages: Column) -> Column:
    """The prompt of a generation row: all turns but the last."""
    return F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))
