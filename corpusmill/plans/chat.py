"""Queries over conversations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chat as C
from ..functions import rewards as R
from ..functions import text as X
from ..operators import windows
from ..sources.io import pinned
from . import questions
from .curation import table


def conversations(s, d) -> DataFrame:
    return C.gather_turns(table(s, d, "conversations"))


def conversation_valid(s, d):
    return conversations(s, d).select("conv_id", C.valid_structure(F.col("messages")).alias("valid"))


def conversation_render(s, d):
    return conversations(s, d).select("conv_id", F.md5(C.render(F.col("messages"), generation_prompt=True)).alias("rendered_md5"))


def last_query(s, d):
    return conversations(s, d).select("conv_id", C.last_query_index(F.col("messages")).cast("long").alias("last_query"))


def system_prompts(s, d):
    m = C.add_system_prompt(F.col("messages"), F.col("conv_id"), ["You are a helpful AI assistant.", "Answer briefly."])
    return conversations(s, d).select("conv_id", (F.size(m) - F.size("messages")).alias("added"), (m[0]["role"] == "system").alias("has_system"), F.when(F.size(m) > F.size("messages"), m[0]["content"]).alias("prompt"))


def think_removed(s, d):
    r = C.render(F.col("messages"))
    return conversations(s, d).select("conv_id", (F.length(r) - F.length(C.drop_empty_think(r, F.col("conv_id")))).alias("removed"))


def _with_calls(s, d) -> DataFrame:
    """Conversations with thoughts and calls beside the content, and tool turns."""
    turn = F.col("turn")
    calls = F.concat(F.lit('[{"name": "calculate_math", "arguments": {"expression":"'), turn.cast("string"), F.lit('+1"}}, {"function": {"name":"get_current_time","arguments":"{}"}}]'))
    x = table(s, d, "conversations").withColumn("role", F.when(turn % 5 == 4, "tool").otherwise(F.col("role")))
    x = x.withColumns({"reasoning_content": F.when(turn % 3 == 0, F.concat(F.lit("\nthought "), turn.cast("string"), F.lit("\n"))), "tool_calls": F.when(turn % 4 == 1, calls)})
    return C.gather_turns(x, extra=["reasoning_content", "tool_calls"])


def conversation_render_full(s, d):
    """X29 with thoughts and calls that come beside the content, and tool turns."""
    return _with_calls(s, d).select("conv_id", F.md5(C.render(F.col("messages"), full=True)).alias("rendered_md5"))


def conversation_render_tools(s, d):
    """X29 with all at once: declared tools, calls, thoughts, tool turns and the opening of an answer."""
    tools = F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit('[{"name":"tool'), F.col("conv_id").cast("string"), F.lit('"}]')))
    m = C.render_with_tools(F.col("messages"), tools, generation_prompt=True, open_thinking=True, full=True)
    return _with_calls(s, d).select("conv_id", F.md5(m).alias("rendered_md5"))


def tools_header(s, d):
    x = conversations(s, d)
    tools = F.concat(F.lit('[{"name":"tool'), F.col("conv_id").cast("string"), F.lit('","parameters":{"n":'), F.size("messages").cast("string"), F.lit("}}]"))
    return x.select("conv_id", F.md5(C.render_with_tools(F.col("messages"), tools)).alias("rendered_md5"))


def role_runs(s, d):
    return windows.neighbours(table(s, d, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "opens", "closes")


def held_out_turns(s, d):
    return conversations(s, d).select("conv_id", F.size(C.hold_out_last(F.col("messages"))).alias("n_prompt_turns"))


def rep_penalty(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", X.repetition_penalty("text").alias("penalty"))


def rule_reward(s, d):
    return table(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", R.rule_reward("text").alias("reward"))


def group_advantage(s, d):
    return windows.group_advantage(pinned(rule_reward(s, d)), "conv_id", "reward").select("conv_id", "turn", "reward", "advantage")


def gae(s, d):
    r = rule_reward(s, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "reward"))), lambda x: x["reward"]).alias("r"))
    a = R.advantages(F.col("r"), F.transform("r", lambda x: x * 0.5), 0.9, 0.8)
    return r.select("conv_id", F.posexplode(a).alias("step", "advantage")).select("conv_id", F.col("step").cast("long").alias("step"), "advantage")


def latest_turn(s, d):
    x = table(s, d, "conversations").select("conv_id", "turn", "role")
    return windows.latest(x, "conv_id", ["turn"]).select("conv_id", "turn", "role")


def objectives(s, d):
    """X28, X35-X40 over numbers made from the turns' lengths."""
    n = (F.length("text") % 97).cast("double") / 97 + 0.1
    p, q = F.array(-n, -n / 2, -n / 4), F.array(-n / 2, -n, -n / 4)
    x = table(s, d, "conversations")
    return x.select(
        "conv_id", "turn", R.preference_loss(-n, -2 * n, -n / 2, -n).alias("preference_loss"), R.clipped_objective(p, q, n).alias("clipped"),
        R.capped_objective(p, q, n).alias("capped"), R.kl_estimate(p, q).alias("kl"), R.candidate_score(p)["mean"].alias("mean_score"), R.cosine_rate(F.col("turn"), F.lit(10), 0.001).alias("rate"),
    )


def token_arrays(s, d):
    """X34-X36, F22 over the turns' code points, as text; every third label is ignored."""
    ids = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c))
    x = table(s, d, "conversations").select("conv_id", "turn", ids.alias("ids"))
    labels = F.transform("ids", lambda t, i: F.when(i % 3 == 0, F.lit(C.IGNORE)).otherwise(t))
    pair = C.shifted(F.col("ids"))
    arrays = {"padded": C.pad(F.col("ids"), 300, 0), "x": pair["x"], "y": pair["y"], "banned": C.banned_tokens(F.col("ids"), 3), "labels": C.valid_labels(labels)}
    return x.select("conv_id", "turn", *[F.array_join(a.cast("array<string>"), " ").alias(k) for k, a in arrays.items()])


QUERIES = {f.__name__: f for f in (
    conversation_valid, conversation_render, last_query, system_prompts, think_removed, role_runs, held_out_turns, rep_penalty, rule_reward, group_advantage, gae,
    latest_turn, objectives, token_arrays, conversation_render_full, conversation_render_tools, tools_header,
)}

#: functions.chat.unit() in SQL.
_UNIT = "(('0x' || substr(md5('{seed}:' || conv_id), 1, 8))::BIGINT / 4294967296.0)"
_REWARD = r"""
    WITH a AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\p{Z}]') AS k FROM conversations),
    g AS (SELECT *, list_transform(range(1, len(k) - 1), lambda i: k[i] || chr(1) || k[i + 1] || chr(1) || k[i + 2]) AS g FROM a),
    pen AS (SELECT conv_id, turn, text, CASE WHEN len(g) = 0 THEN 0.0 ELSE least(0.5, (len(g) - len(list_distinct(g))) * 0.5 * 2 / len(g)) END AS penalty FROM g),
    rw AS (SELECT conv_id, turn, (CASE WHEN length(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) BETWEEN 20 AND 800 THEN 0.5 ELSE -0.5 END - penalty)::DOUBLE AS reward
           FROM pen JOIN conversations USING (conv_id, turn, text) WHERE role = 'assistant')"""

#: Turns as the template writes them, with thoughts, calls and tool turns.
_FULL = r"""
        WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'tool' ELSE role END AS role, text, lag(CASE WHEN turn % 5 = 4 THEN 'tool' ELSE role END) OVER w AS prior, lead(CASE WHEN turn % 5 = 4 THEN 'tool' ELSE role END) OVER w AS nxt
            FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        r AS (SELECT conv_id, turn, CASE
            WHEN role = 'assistant' THEN '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || CASE WHEN turn % 3 = 0 THEN 'thought ' || turn ELSE '' END || chr(10) || '</think>' || chr(10) || chr(10) || ltrim(text, chr(10))
                || CASE WHEN turn % 4 = 1 THEN CASE WHEN text <> '' THEN chr(10) ELSE '' END || '<tool_call>' || chr(10) || '{"name": "calculate_math", "arguments": {"expression": "' || turn || '+1"}}' || chr(10) || '</tool_call>' || chr(10) || '<tool_call>' || chr(10) || '{"name": "get_current_time", "arguments": {}}' || chr(10) || '</tool_call>' ELSE '' END || '<|im_end|>' || chr(10)
            WHEN role = 'tool' THEN CASE WHEN prior IS DISTINCT FROM 'tool' THEN '<|im_start|>user' ELSE '' END || chr(10) || '<tool_response>' || chr(10) || text || chr(10) || '</tool_response>' || CASE WHEN nxt IS DISTINCT FROM 'tool' THEN '<|im_end|>' || chr(10) ELSE '' END
            ELSE '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) END AS x FROM t)"""
_HEAD = r"""'<|im_start|>system' || chr(10) || CASE WHEN arg_min(CASE WHEN turn % 5 = 4 THEN 'tool' ELSE role END, turn) = 'system' THEN arg_min(text, turn) || chr(10) || chr(10) ELSE '' END || '# Tools' || chr(10) || chr(10)
            || 'You may call one or more functions to assist with the user query.' || chr(10) || chr(10) || 'You are provided with function signatures within <tools></tools> XML tags:' || chr(10) || '<tools>' || chr(10)"""
_AFTER_TOOLS = r"""chr(10) || '</tools>' || chr(10) || chr(10) || 'For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:' || chr(10) || '<tool_call>' || chr(10)
            || '{"name": <function-name>, "arguments": <args-json-object>}' || chr(10) || '</tool_call><|im_end|>' || chr(10)"""

ORACLES = {
    "conversation_valid": r"""
        WITH n AS (SELECT conv_id, turn, role, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
        SELECT conv_id, count(*) >= 2 AND coalesce(bool_and(role = 'user' AND t <> '') FILTER (i = 1), false) AND coalesce(bool_and(role = 'assistant' AND length(t) >= 5) FILTER (i = 2), false) AS valid FROM n GROUP BY 1""",
    "conversation_render": r"""
        SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || CASE WHEN role = 'assistant' THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || ltrim(text, chr(10)) ELSE text END || '<|im_end|>' || chr(10), '' ORDER BY turn)
            || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10)) AS rendered_md5 FROM conversations GROUP BY 1""",
    "last_query": "WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) SELECT conv_id, coalesce(max(i) FILTER (role = 'user'), max(i)) AS last_query FROM n GROUP BY 1",
    "role_runs": "SELECT conv_id, turn, lag(role) OVER w IS NULL OR lag(role) OVER w <> role AS opens, lead(role) OVER w IS NULL OR lead(role) OVER w <> role AS closes FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "held_out_turns": "SELECT conv_id, (count(*) - 1)::INT AS n_prompt_turns FROM conversations GROUP BY 1",
    "rep_penalty": _REWARD + " SELECT conv_id, turn, penalty::DOUBLE AS penalty FROM pen",
    "rule_reward": _REWARD + " SELECT conv_id, turn, reward FROM rw",
    "group_advantage": _REWARD + " SELECT conv_id, turn, reward, (reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-4) AS advantage FROM rw WINDOW w AS (PARTITION BY conv_id)",
    "latest_turn": "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY 1",
    "objectives": """
        WITH n AS (SELECT conv_id, turn, (length(text) % 97)::DOUBLE / 97 + 0.1 AS n FROM conversations),
        r AS (SELECT *, -n AS p1, -n / 2 AS p2, -n / 2 AS q1, -n AS q2 FROM n)
        SELECT conv_id, turn, ln(1 + exp(-0.1 * (n - n / 2))) AS preference_loss,
            (least(exp(p1 - q1) * n, greatest(least(exp(p1 - q1), 1.2), 0.8) * n) + least(exp(p2 - q2) * n, greatest(least(exp(p2 - q2), 1.2), 0.8) * n) + n) / 3 AS clipped,
            (least(exp(p1 - q1), 5) * n * p1 + least(exp(p2 - q2), 5) * n * p2 - n * n / 4) / 3 AS capped,
            (exp(q1 - p1) - (q1 - p1) - 1 + exp(q2 - p2) - (q2 - p2) - 1) / 3 AS kl, (-n - n / 2 - n / 4) / 3 AS mean_score, 0.001 * (0.1 + 0.45 * (1 + cos(pi() * turn / 10))) AS rate FROM r""",
    "conversation_render_full": _FULL + " SELECT conv_id, md5(string_agg(x, '' ORDER BY turn)) AS rendered_md5 FROM r GROUP BY 1",
    "conversation_render_tools": _FULL + f""", f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM r JOIN conversations c USING (conv_id, turn))
        SELECT conv_id, md5(CASE WHEN conv_id % 3 > 0 THEN {_HEAD} || '{{"name": "tool' || conv_id || '"}}' || {_AFTER_TOOLS} || coalesce(string_agg(x, '' ORDER BY turn) FILTER (role <> 'system' OR turn <> first OR turn % 5 = 4), '') ELSE string_agg(x, '' ORDER BY turn) END
            || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10)) AS rendered_md5 FROM f GROUP BY conv_id""",
    "tools_header": r"""
        SELECT conv_id, md5('<|im_start|>system' || chr(10) || CASE WHEN arg_min(role, turn) = 'system' THEN arg_min(text, turn) || chr(10) || chr(10) ELSE '' END || '# Tools' || chr(10) || chr(10) || 'You may call one or more functions to assist with the user query.' || chr(10) || chr(10)
            || 'You are provided with function signatures within <tools></tools> XML tags:' || chr(10) || '<tools>' || chr(10) || '{"name": "tool' || conv_id || '", "parameters": {"n": ' || count(*) || '}}' || chr(10) || '</tools>' || chr(10) || chr(10)
            || 'For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:' || chr(10) || '<tool_call>' || chr(10) || '{"name": <function-name>, "arguments": <args-json-object>}' || chr(10) || '</tool_call><|im_end|>' || chr(10)
            || coalesce(string_agg('<|im_start|>' || role || chr(10) || CASE WHEN role = 'assistant' THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || ltrim(text, chr(10)) ELSE text END || '<|im_end|>' || chr(10), '' ORDER BY turn) FILTER (role <> 'system' OR turn <> first), '')) AS rendered_md5
        FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations) GROUP BY 1""",
    "system_prompts": f"""
        WITH c AS (SELECT conv_id, arg_min(role, turn) <> 'system' AND {_UNIT.format(seed=0)} < 0.2 AS added, arg_min(role, turn) AS first, CASE WHEN {_UNIT.format(seed=1)} < 0.5 THEN 'You are a helpful AI assistant.' ELSE 'Answer briefly.' END AS prompt FROM conversations GROUP BY 1)
        SELECT conv_id, added::INT AS added, added OR first = 'system' AS has_system, CASE WHEN added THEN prompt END AS prompt FROM c""",
    "think_removed": f"SELECT conv_id, (CASE WHEN {_UNIT.format(seed=0)} > 0.2 THEN 19 * count(*) FILTER (role = 'assistant') ELSE 0 END)::INT AS removed FROM conversations GROUP BY 1",
    "gae": _REWARD + """, n AS (SELECT conv_id, row_number() OVER w - 1 AS step, reward, coalesce(lead(reward) OVER w, 0) AS after FROM rw WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        d AS (SELECT conv_id, step, reward + 0.9 * 0.5 * after - 0.5 * reward AS delta FROM n)
        SELECT x.conv_id, x.step, sum(pow(0.9 * 0.8, y.step - x.step) * y.delta) AS advantage FROM d x JOIN d y ON x.conv_id = y.conv_id AND y.step >= x.step GROUP BY 1, 2""",
    "token_arrays": """
        WITH c AS (SELECT conv_id, turn, list_transform(range(1, length(text) + 1), lambda i: unicode(substring(text, i, 1))) AS ids, length(text) AS n FROM conversations),
        g AS (SELECT *, list_filter(range(1, n - 1), lambda i: ids[i] = ids[n - 1] AND ids[i + 1] = ids[n]) AS hits FROM c)
        SELECT conv_id, turn, array_to_string(list_transform(range(1, 301), lambda i: coalesce(ids[i], 0)), ' ') AS padded, array_to_string(list_slice(ids, 1, n - 1), ' ') AS x, array_to_string(list_slice(ids, 2, n), ' ') AS y,
            CASE WHEN n < 3 THEN '' ELSE array_to_string(list_sort(list_distinct(list_transform(hits, lambda i: ids[i + 2]))), ' ') END AS banned,
            array_to_string(list_transform(list_filter(range(0, n), lambda i: i % 3 <> 0), lambda i: ids[i + 1]), ' ') AS labels FROM g""",
}

QUERIES |= questions.QUERIES
ORACLES |= questions.ORACLES
