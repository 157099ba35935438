"""Rewards, objectives and schedules as column expressions."""

from __future__ import annotations

import ast
import math
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chat import parse_tool_calls
from .text import repetition_penalty, strip, text

#: Arguments that a call of each tool must have.  Fixed values.
REQUIRED = {
    "calculate_math": ["expression"], "unit_converter": ["value", "from_unit", "to_unit"], "get_current_weather": ["location"],
    "get_current_time": [], "get_exchange_rate": ["from_currency", "to_currency"], "translate_text": ["text", "target_language"],
}


def arguments_ok(name: Column, arguments: Column) -> Column:
    """Whether a known tool's required arguments are there and not empty."""
    out = F.lit(False)
    for tool, keys in REQUIRED.items():
        ok = F.lit(True)
        for k in keys:
            v = F.get_json_object(arguments, f"$.{k}")
            ok = ok & v.isNotNull() & (F.lit(True) if (tool, k) == ("unit_converter", "value") else v != "")
        out = F.when(name == tool, ok).otherwise(out)
    return out


_NUMBER = r"(?<![\w.])([-+]?\d+(?:\.\d+)?)(?![\w.])"


def verified_truths(c: Column | str, truths: Column) -> Column:
    """Truths that stand in the text, as a string in any case or as a number."""
    t = text(c)
    numbers = F.transform(F.regexp_extract_all(F.replace(t, F.lit(","), F.lit("")), F.lit(_NUMBER), F.lit(1)), lambda x: x.cast("double"))

    def holds(g: Column) -> Column:
        s = strip(g)
        plain = F.replace(s, F.lit(","), F.lit(""))
        number = F.when(plain.rlike(r"^[-+]?\d+(?:\.\d+)?$"), plain.cast("double"))
        return ((s != "") & F.contains(F.lower(t), F.lower(s))) | F.coalesce(F.exists(numbers, lambda n: F.abs(n - number) < 1e-6), F.lit(False))

    return F.array_distinct(F.filter(truths, holds))


def _after_first(t: Column, mark: str) -> Column:
    return F.substr(t, F.instr(t, mark) + len(mark))


def rule_reward(c: Column | str, score: Column | None = None, least: int = 20) -> Column:
    """Length, thoughts, closing tag, repetition, and the model's score; not clipped."""
    t = text(c)
    thinks = F.contains(t, F.lit("</think>"))
    size, thought = F.length(strip(t)), F.length(strip(F.substring_index(t, "</think>", 1)))
    closings = F.size(F.split(t, "</think>")) - 1
    answer = F.when(thinks, strip(_after_first(t, "</think>"))).otherwise(t)
    out = F.when(size.between(least, 800), 0.5).otherwise(-0.5)
    out = out + F.when(thinks, F.when(thought.between(20, 300), 1.0).otherwise(-0.5) + F.when(closings == 1, 0.25).otherwise(-0.25)).otherwise(0.0)
    return out - repetition_penalty(answer) + (score if score is not None else F.lit(0.0))


def agent_reward(turns: Column, truths: Column, tool_names: Column, unfinished: Column, score: Column | None = None) -> Column:
    """X26 for agents: without calls the rule reward from 5 characters on; with calls the calls'
    fit, the truths that the final text has, and repetition; clipped to 3 either way.

    turns: the outputs in order; a single text is an array of one."""
    answers = F.transform(turns, lambda t: F.when(F.contains(t, F.lit("</think>")), strip(_after_first(t, "</think>"))).otherwise(strip(t)))
    answer = F.coalesce(F.try_element_at(answers, F.lit(-1)), F.lit(""))
    response = F.array_join(turns, "")
    calls = F.flatten(F.transform(answers, parse_tool_calls))
    opened = F.aggregate(answers, F.lit(0), lambda a, t: a + F.abs(F.size(F.split(t, "<tool_call>")) - F.size(F.split(t, "</tool_call>"))))
    valid = F.size(F.filter(calls, lambda x: F.array_contains(tool_names, x["name"]) & arguments_ok(x["name"], x["arguments"])))
    gap = F.abs(valid - F.size(truths)) + F.greatest(F.size(calls) - valid, F.lit(0))
    final = F.when(unfinished, F.lit("")).otherwise(F.substring_index(answer, "</tool_call>", -1))
    found = F.when(F.size(truths) > 0, 2.5 * F.size(verified_truths(final, truths)) / F.size(truths)).otherwise(0.0)
    with_calls = F.when(gap == 0, 0.5).otherwise(-0.5 * gap) + found - F.when(unfinished, 0.5).otherwise(0.0) - repetition_penalty(F.when(final != "", final).otherwise(answer))
    reward = F.when(F.size(calls) == 0, rule_reward(response, score, least=5)).otherwise(with_calls) - 0.5 * opened
    return F.greatest(F.least(reward, F.lit(3.0)), F.lit(-3.0))


def advantages(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages of one sequence, from its per-token rewards and values."""
    n = F.size(values)
    deltas = F.transform(values, lambda v, t: F.get(rewards, t) + gamma * F.coalesce(F.get(values, t + 1), F.lit(0.0)) - v)
    back = F.aggregate(F.reverse(deltas), F.array().cast("array<double>"), lambda acc, d: F.concat(acc, F.array(d + gamma * lam * F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))))
    return F.when(n > 0, F.reverse(back)).otherwise(F.array().cast("array<double>"))


def preference_loss(policy_chosen: Column, policy_rejected: Column, base_chosen: Column, base_rejected: Column, beta: float = 0.1) -> Column:
    """-log sigmoid(beta (policy ratio - base ratio))."""
    margin = beta * ((policy_chosen - policy_rejected) - (base_chosen - base_rejected))
    return F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))


def clipped_objective(logp: Column, old_logp: Column, advantage: Column, epsilon: float = 0.2) -> Column:
    """Mean over tokens of min(ratio A, clip(ratio) A)."""
    per = F.zip_with(logp, old_logp, lambda p, q: F.least(F.exp(p - q) * advantage, F.greatest(F.least(F.exp(p - q), F.lit(1 + epsilon)), F.lit(1 - epsilon)) * advantage))
    return F.try_divide(F.aggregate(per, F.lit(0.0), lambda a, x: a + x), F.size(per))


def capped_objective(logp: Column, old_logp: Column, advantage: Column, cap: float = 5.0) -> Column:
    """Mean over tokens of min(ratio, cap) A log p, the ratio as a constant weight."""
    per = F.zip_with(logp, old_logp, lambda p, q: F.least(F.exp(p - q), F.lit(cap)) * advantage * p)
    return F.try_divide(F.aggregate(per, F.lit(0.0), lambda a, x: a + x), F.size(per))


def kl_estimate(logp: Column, base_logp: Column) -> Column:
    """Mean over tokens of exp(d) - d - 1 with d = base - policy."""
    per = F.zip_with(logp, base_logp, lambda p, q: F.exp(q - p) - (q - p) - 1)
    return F.try_divide(F.aggregate(per, F.lit(0.0), lambda a, x: a + x), F.size(per))


def candidate_score(logps: Column) -> Column:
    """struct(sum, mean) of a candidate's token log-probabilities."""
    total = F.aggregate(logps, F.lit(0.0), lambda a, x: a + x)
    return F.struct(total.alias("total"), F.try_divide(total, F.size(logps)).alias("mean"))


def cosine_rate(step: Column, total: Column, base: float) -> Column:
    """From the base rate down to a tenth of it along a half cosine."""
    return base * (0.1 + 0.45 * (1 + F.cos(math.pi * step / total)))


def accuracy_verdict(accuracy: Column, threshold: Column) -> Column:
    """Beats is strict; no threshold, no baseline."""
    return F.when(threshold.isNull(), "no_baseline").when(accuracy > threshold, "beats_random").otherwise("not_distinguishable")


_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}
_FUNCTIONS = {"sqrt": math.sqrt, "sin": math.sin, "cos": math.cos, "tan": math.tan, "log": math.log, "exp": math.exp, "pi": math.pi, "e": math.e}


def arithmetic(expression: str) -> float | int:
    """Value of an arithmetic expression; anything else is a ValueError.  Nothing is evaluated as code."""

    def bounded(v):
        if isinstance(v, int) and v.bit_length() > 4096 or isinstance(v, complex):
            raise ValueError("result too large")
        return v

    def value(node):
        match node:
            case ast.Expression(body=body):
                return value(body)
            case ast.Constant(value=int() | float() as v) if not isinstance(v, bool):
                return v
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _OPS:
                x, y = value(a), value(b)
                if isinstance(op, ast.Pow) and (abs(y) > 1000 or abs(x) > 1e6):
                    raise ValueError("power too large")
                return bounded(_OPS[type(op)](x, y))
            case ast.UnaryOp(op=op, operand=a) if type(op) in _OPS:
                return _OPS[type(op)](value(a))
            case ast.Call(func=ast.Attribute(value=ast.Name(id="math"), attr=f) | ast.Name(id=f), args=args, keywords=[]) if callable(_FUNCTIONS.get(f)):
                return _FUNCTIONS[f](*map(value, args))
            case ast.Attribute(value=ast.Name(id="math"), attr=f) | ast.Name(id=f) if isinstance(_FUNCTIONS.get(f), float):
                return _FUNCTIONS[f]
        raise ValueError("not arithmetic")

    for a, b in zip("^×÷−（）", ("**", "*", "/", "-", "(", ")"), strict=True):
        expression = expression.replace(a, b)
    return value(ast.parse(expression.strip(), mode="eval"))


@F.pandas_udf(T.StringType())
def evaluate_arithmetic(c: pd.Series) -> pd.Series:
    """Results as text; null where the expression is no arithmetic."""

    def one(x):
        try:
            return str(arithmetic(x or ""))
        except (ValueError, SyntaxError, ArithmeticError, TypeError, RecursionError, MemoryError):
            return None

    return c.map(one)
