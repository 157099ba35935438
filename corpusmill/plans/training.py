"""Queries of training rows and resumable stages, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chat as C
from ..functions import decoding as D
from ..functions import text as X
from ..operators import dedup, filters, scans, stages, training, vocabulary
from ..sources.io import scratch
from .curation import SQL_NORM, docs, table

PROMPTS = ["You are a helpful AI assistant.", "Answer briefly."]


def _tokens() -> training.Tokens:
    import public_tokenizers

    return training.Tokens(public_tokenizers.path("byte_bpe_50k.json"))


def pretraining_rows(s, d):
    x = table(s, d, "conversations").select("conv_id", "turn", "text")
    return training.pretraining_rows(x, "text", _tokens(), 256).drop("text")


def finetuning_rows(s, d):
    x = C.gather_turns(table(s, d, "conversations"))
    return training.finetuning_rows(x, "conv_id", "messages", _tokens(), 512, prompts=PROMPTS).drop("messages")


def finetuning_tool_rows(s, d):
    """Conversations with tools declared, called and answered: every third turn calls, every fifth is a tool's."""
    turn = F.col("turn")
    calls = F.concat(F.lit('[{"name": "lookup", "arguments": {"n": '), turn.cast("string"), F.lit("}}]"))
    x = table(s, d, "conversations").withColumns({"role": F.when(turn % 5 == 4, "tool").otherwise(F.col("role")), "reasoning_content": F.when(turn % 2 == 1, "so\n"), "tool_calls": F.when(turn % 3 == 1, calls)})
    x = C.gather_turns(x, extra=["reasoning_content", "tool_calls"])
    x = x.withColumn("tools", F.when(F.col("conv_id") % 2 == 0, '[{"name": "lookup", "parameters": {"n": "int"}}]'))
    return training.finetuning_rows(x, "conv_id", "messages", _tokens(), 512, tools="tools", full=True).drop("messages", "tools")


def preference_rows(s, d):
    """The rejected side ends in the words of the turn before the last."""
    x = C.gather_turns(table(s, d, "conversations"))
    worse = F.transform("messages", lambda m, i: F.struct(m["turn"].alias("turn"), m["role"].alias("role"), F.when((i > 0) & (i == F.size("messages") - 1), F.get("messages", i - 1)["content"]).otherwise(m["content"]).alias("content")))
    return training.preference_rows(x.withColumn("worse", worse), "conv_id", "messages", "worse", _tokens(), 384).drop("messages", "worse")


def rollout_prompts(s, d):
    x = C.gather_turns(table(s, d, "conversations"))
    return training.rollout_prompts(x, "conv_id", "messages", prompts=PROMPTS).drop("messages")


def agent_rows(s, d):
    """Tools stand at system turns; the truth is the last turn's first word."""
    declared = F.when(F.col("role") == "system", F.concat(F.lit('[{"name": "t'), F.length("text").cast("string"), F.lit('"}]')))
    x = C.gather_turns(table(s, d, "conversations").withColumn("tools", declared), extra=["tools"])
    truth = F.array(F.substring_index(F.try_element_at("messages", F.lit(-1))["content"], " ", 1))
    out = training.agent_rows(x.withColumn("truths", truth), "messages", "tools", "truths")
    return out.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "|").alias("turns"), "tools", F.array_join("gt", "|").alias("gt"))


def resumed_stages(s, d):
    """Three stages run, and run again: the second run reads what the ledger has."""
    folder, first = scratch(s, "ledger"), docs(s, d).select("doc_id", "text", "lang")
    todo = [
        ("long_enough", lambda x: x.where(filters.long_enough("text", 8))),
        ("first_of_text", lambda x: dedup.keep_first(x.withColumn("_key", X.norm_space("text")), "_key", "doc_id").select("doc_id", "lang")),
        ("by_language", lambda x: x.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))),
    ]
    options = {"fingerprint": stages.files_fingerprint(s, first), "code": stages.code_fingerprint("corpusmill.functions", "corpusmill.operators")}
    stages.run_stages(s, folder, first, todo, **options)
    again = stages.run_stages(s, folder, first, todo, **options)
    return again.result.select("lang", "n", F.lit(sum(x.reused for x in again.stages)).cast("long").alias("stages_read"))


def merge_counts(s, d):
    """What the first 200 merges of a public vocabulary find in the documents."""
    path = _tokens().path
    return vocabulary.merge_counts(vocabulary.word_counts(docs(s, d), "text", path), path, 200)


def piece_counts(s, d):
    """Pieces of a public vocabulary over the documents."""
    path = _tokens().path
    return vocabulary.piece_counts(vocabulary.word_counts(docs(s, d), "text", path), path)


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def next_tokens(s, d):
    """Letters as tokens, scored by how often a document has them; what its last letters hold is seen, one is banned."""
    t = F.lower(X.text("text"))
    x = docs(s, d).select("doc_id", F.array(*[F.log1p((F.length(t) - F.length(F.translate(t, c, ""))).cast("double")) - 1.5 for c in LETTERS]).alias("scores"), F.substr(t, F.greatest(F.length(t) - 19, F.lit(1)), F.lit(20)).alias("tail"))
    seen = F.filter(F.array(*[F.when(F.contains("tail", F.lit(c)), k) for k, c in enumerate(LETTERS)]), lambda i: i.isNotNull())
    pick = lambda **o: D.choose_token(F.col("scores"), seen, F.array((F.col("doc_id") % 26).cast("int")), C.unit(F.col("doc_id"), 5), penalty=1.3, **o)
    x = x.select("doc_id", pick(top_k=12, top_p=0.8).alias("drawn"), pick(top_k=0, top_p=1.0, greedy=True).alias("best"))
    return x.select("doc_id", "drawn.token", "drawn.probability", "drawn.candidates", F.col("best.token").alias("best_token"))


def long_advantages(s, d):
    """W9 along all documents of a language: a sequence has a third of all rows."""
    x = docs(s, d).select("doc_id", "lang", (F.col("n_chars") % 97 / 97).alias("reward"), (F.col("n_chars") % 89 / 89).alias("value"))
    return scans.long_advantages(x, "lang", "doc_id", "reward", "value", 0.9, 0.8).select("doc_id", "advantage")


QUERIES = {f.__name__: f for f in (pretraining_rows, finetuning_rows, finetuning_tool_rows, preference_rows, rollout_prompts, agent_rows, resumed_stages, merge_counts, piece_counts, next_tokens, long_advantages)}

_UNIT = "(('0x' || substr(md5('{seed}:' || conv_id), 1, 8))::BIGINT / 4294967296.0)"
_THOUGHTS = "'<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10)"
#: Ids of a tokenizer can't be told in SQL; tests/test_training.py holds those queries against plain Python.
ORACLES = {
    "rollout_prompts": f"""
        WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
        c AS (SELECT conv_id, bool_or(i = 1 AND role <> 'system') AND {_UNIT.format(seed=0)} < 0.2 AS added, {_UNIT.format(seed=1)} < 0.5 AS first_prompt, {_UNIT.format(seed=2)} < 0.5 AS opened,
            coalesce(string_agg(CASE WHEN role = 'assistant' THEN {_THOUGHTS} || ltrim(text, chr(10)) ELSE '<|im_start|>' || role || chr(10) || text END || '<|im_end|>' || chr(10), '' ORDER BY turn) FILTER (i < n), '') AS body FROM t GROUP BY conv_id)
        SELECT conv_id, CASE WHEN added THEN '<|im_start|>system' || chr(10) || CASE WHEN first_prompt THEN '{PROMPTS[0]}' ELSE '{PROMPTS[1]}' END || '<|im_end|>' || chr(10) ELSE '' END || body
            || CASE WHEN opened THEN '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) ELSE {_THOUGHTS} END AS prompt, '' AS answer FROM c""",
    "agent_rows": """
        WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
        SELECT conv_id, coalesce(string_agg(role || ':' || text, '|' ORDER BY turn) FILTER (i < n), '') AS turns, '[{"name": "t' || arg_max(length(text), turn) FILTER (role = 'system') || '"}]' AS tools,
            split_part(arg_max(text, turn), ' ', 1) AS gt FROM t GROUP BY conv_id""",
    "resumed_stages": f"""
        WITH k AS (SELECT doc_id, lang, {SQL_NORM} AS k FROM documents), f AS (SELECT arg_min(lang, doc_id) AS lang FROM k WHERE length(k) >= 8 GROUP BY k)
        SELECT lang, count(*) AS n, 3::BIGINT AS stages_read FROM f GROUP BY lang""",
    "next_tokens": f"""
        WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t, {_UNIT.format(seed=5).replace("conv_id", "doc_id")} AS u FROM documents),
        s AS (SELECT doc_id, u, k AS id, (ln(1 + length(t) - length(replace(t, chr(97 + k::INT), ''))) - 1.5) / 0.85 AS s, contains(right(t, 20), chr(97 + k::INT)) AS seen FROM t, range(26) r(k)),
        p AS (SELECT doc_id, u, id, CASE WHEN NOT seen THEN s WHEN s > 0 THEN s / 1.3 ELSE s * 1.3 END AS s FROM s WHERE id <> doc_id % 26),
        k AS (SELECT *, max(s) OVER w AS top, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, id) AS place FROM p WINDOW w AS (PARTITION BY doc_id)),
        e AS (SELECT *, exp(s - top) AS e FROM k QUALIFY s >= max(s) FILTER (place = 12) OVER (PARTITION BY doc_id)),
        m AS (SELECT *, sum(e) OVER (PARTITION BY doc_id ORDER BY place) / sum(e) OVER (PARTITION BY doc_id) AS mass FROM e),
        c AS (SELECT *, coalesce(lag(mass) OVER (PARTITION BY doc_id ORDER BY place), 0) AS before FROM m QUALIFY before <= 0.8),
        q AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id) AS q, sum(e) OVER (PARTITION BY doc_id ORDER BY id) / sum(e) OVER (PARTITION BY doc_id) AS reached FROM c)
        SELECT doc_id, arg_min(id, id) FILTER (reached > u)::INT AS token, arg_min(q, id) FILTER (reached > u) AS probability, count(*)::INT AS candidates, arg_min(id, place)::INT AS best_token FROM q GROUP BY doc_id""",
    "long_advantages": """
        WITH n AS (SELECT doc_id, lang, n_chars % 97 / 97 AS r, n_chars % 89 / 89 AS v, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
        d AS (SELECT n.*, r - v + 0.9 * coalesce(lead(v) OVER (PARTITION BY lang ORDER BY i), 0) AS delta FROM n)
        SELECT x.doc_id, sum(pow(0.9 * 0.8, y.i - x.i) * y.delta) AS advantage FROM d x JOIN d y ON y.lang IS NOT DISTINCT FROM x.lang AND y.i BETWEEN x.i AND x.i + 150 GROUP BY x.doc_id""",
}
