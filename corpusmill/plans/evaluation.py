"""Queries that score rule predictions against labels, and their SQL.

Truth is labels.quality as good or bad; two rules predict it from the document: a, by length
(long, mid for "no call", short), and b, by the share of distinct bigrams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rewards
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import joins, sampling, validation, windows
from .curation import SQL_BIGRAMS, labelled, table

LABELS = ["good", "bad"]


def predictions(s, d) -> DataFrame:
    x = labelled(s, d)
    n = F.length(X.text("text"))
    d2 = X.distinct2("text")
    return x.select(
        "doc_id", "lang", "source", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"),
        F.when(n >= 1000, "good").when(n >= 600, F.lit(None)).otherwise("bad").alias("a"),
        F.when(d2 >= 0.25, "good").otherwise("bad").alias("b"), n.cast("long").alias("n_tokens"), d2.alias("d2"),
    )


_P = f"""
    WITH t AS (SELECT doc_id, lang, source, quality, coalesce(text, '') AS text FROM documents JOIN labels USING (doc_id)),
    u AS (SELECT *, length(text) AS n, CASE WHEN length(text) < 2 THEN 0.0 ELSE len(list_distinct({SQL_BIGRAMS.format(t="text")})) / (length(text) - 1) END AS d2 FROM t),
    p AS (SELECT doc_id, lang, source, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS truth,
        CASE WHEN n >= 1000 THEN 'good' WHEN n >= 600 THEN NULL ELSE 'bad' END AS a, CASE WHEN d2 >= 0.25 THEN 'good' ELSE 'bad' END AS b, n AS n_tokens, d2 FROM u)"""


def label_counts(s, d):
    return A.count_labels(predictions(s, d), "a", [*LABELS, "unused"]).select("label", "n")


def length_stats(s, d):
    return A.length_stats(table(s, d, "documents"), X.text("text"), ["lang"])


def letter_counts(s, d):
    return A.count_by_letter(table(s, d, "documents"), "lang", ["en", "fr", "de", "es", "xx"])


def rates(s, d):
    p = predictions(s, d).withColumn("right_a", F.col("a") == F.col("truth")).withColumn("right_b", F.col("b") == F.col("truth")).withColumn("agree", F.col("a").eqNullSafe(F.col("b")))
    return A.rates(p, ["right_a", "right_b", "agree"], ["lang"])


def confusion(s, d):
    return A.confusion(predictions(s, d), "truth", "a", LABELS)


def class_scores(s, d):
    return A.class_scores(confusion(s, d))


def macro_f1(s, d):
    return A.macro_f1(confusion(s, d))


def predicted_distribution(s, d):
    return A.predicted_distribution(predictions(s, d), "a")


def collapse(s, d):
    return A.collapse(predictions(s, d), "b")


def baseline_band(s, d):
    c = predictions(s, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return c.select("lang", "n", A.chance_band(F.col("n"), 2).alias("r")).select("lang", "n", "r.*")


def transitions(s, d):
    p = predictions(s, d)
    return A.transitions(p.select((F.col("a") == F.col("truth")).alias("x"), (F.col("b") == F.col("truth")).alias("y")), "x", "y")


def mcnemar(s, d):
    p = predictions(s, d)
    return A.mcnemar(p.select("lang", (F.col("a") == F.col("truth")).alias("x"), (F.col("b") == F.col("truth")).alias("y")), "x", "y", ["lang"])


def paired_predictions(s, d):
    p = predictions(s, d)
    return joins.strict_join(p.select("doc_id", "a"), p.select("doc_id", "b"), "doc_id")


def weighted_loss(s, d):
    return A.weighted_mean(predictions(s, d).withColumn("loss", F.col("d2") * F.col("n_tokens")), "loss", "n_tokens", ["lang"])


def whitened(s, d):
    p = predictions(s, d).withColumn("mask", F.when(F.col("truth") == "good", 1).otherwise(0))
    return A.whiten(p, "d2", "mask").select("doc_id", "whitened")


def medians(s, d):
    return A.median(predictions(s, d), "n_tokens", ["lang"])


def distinct_check(s, d):
    return A.distinct_check(table(s, d, "documents").withColumn("k", X.norm_space("text")), "k")


def max_tokens(s, d):
    return A.max_by_split(predictions(s, d).withColumn("split", F.col("doc_id") % 3), "n_tokens", "split")


def _curve(s, d) -> DataFrame:
    p = predictions(s, d)
    size = F.explode(F.array(*[F.lit(x) for x in (1, 2, 4, 8)]))
    hit = p.select(size.alias("size"), "doc_id", "d2", "truth").withColumn("right", F.when(F.col("d2") >= 0.6 / F.col("size"), "good").otherwise("bad") == F.col("truth"))
    return hit.select("size", "doc_id", "right")


def adjacent_points(s, d):
    acc = _curve(s, d).groupBy("size").agg(F.avg(F.col("right").cast("double")).alias("accuracy"))
    return windows.adjacent(acc, "size", "accuracy")


def run_pairs(s, d):
    """Each point's rows with those of the next point of the curve."""
    c = _curve(s, d)
    nxt = c.select((F.col("size") / 2).cast("int").alias("size"), "doc_id", F.col("right").alias("next_right"))
    return A.mcnemar(c.join(nxt, ["size", "doc_id"]), "right", "next_right", ["size"])


def saturation(s, d):
    steps = run_pairs(s, d).withColumn("next_size", F.col("size") * 2)
    return windows.saturation(steps, "size", "next_size", "p")


def running_best(s, d):
    p = predictions(s, d).withColumn("loss", 1 - F.col("d2"))
    return windows.running_best(p, "doc_id", "loss", "lang").select("doc_id", "is_best")


def argmax_label(s, d):
    p = predictions(s, d)
    both = p.select("doc_id", F.explode(F.array(F.struct(F.lit("good").alias("label"), F.least("d2", F.lit(0.3)).alias("score")), F.struct(F.lit("bad").alias("label"), F.lit(0.3).alias("score")))).alias("c")).select("doc_id", "c.*")
    return sampling.arg_best(both, "doc_id", "label", "score", LABELS)


def verdicts(s, d):
    p = predictions(s, d)
    acc = p.groupBy("source").agg(F.avg((F.col("b") == F.col("truth")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return acc.select("source", rewards.accuracy_verdict(F.col("accuracy"), A.chance_band(F.col("n"), 2)["high"]).alias("verdict"))


def acceptance(s, d):
    x = table(s, d, "documents")
    checks = {
        "ids are unique": F.count(F.lit(1)) == F.countDistinct("doc_id"),
        "lengths agree": F.count_if(F.length("text") != F.col("n_chars")) == 0,
        "languages are known": F.count_if(~F.col("lang").isin("en", "fr", "de", "es")) == 0,
        "no copies": F.count(F.lit(1)) == F.countDistinct("text"),
    }
    return validation.acceptance(x, checks, {"no copies": F.count(F.lit(1)) - F.countDistinct("text")})


def split_leakage(s, d):
    k = table(s, d, "documents").select("doc_id", F.md5(X.norm_space("text")).alias("k"))
    return validation.leakage({n: k.where(F.col("doc_id") % 3 == i) for i, n in enumerate(("train", "val", "test"))}, "k")


def broken_references(s, d):
    raw = table(s, d, "documents").select(F.col("doc_id").alias("row_id"), "text")
    x = raw.select((F.col("row_id") + F.when(F.col("row_id") % 50 == 0, 1).otherwise(0)).alias("source_row"), "text", F.col("row_id").alias("doc_id"))
    return validation.broken_references(x, raw, ["text"]).select("doc_id")


def recomputed_metrics(s, d):
    x = table(s, d, "documents").withColumn("stored", F.when(F.col("doc_id") % 100 == 0, -1).otherwise(F.col("n_chars")))
    return validation.recomputed(x, "doc_id", {"n_chars": "stored"}, {"n_chars": F.length("text").cast("long")})


def split_balance(s, d):
    from .curation import balanced_split

    return validation.balanced(balanced_split(s, d), "lang", "split", 4)


_C = _P + """, g AS (SELECT t.l AS truth, q.l AS predicted FROM (VALUES ('good'), ('bad')) t(l), (VALUES ('good'), ('bad'), ('INVALID')) q(l)),
    m AS (SELECT g.truth, g.predicted, count(p.doc_id) AS n FROM g LEFT JOIN p ON p.truth = g.truth AND coalesce(p.a, 'INVALID') = g.predicted GROUP BY 1, 2),
    tp AS (SELECT truth AS label, sum(n) FILTER (predicted = truth) AS tp, sum(n) AS actual FROM m GROUP BY 1),
    sc AS (SELECT label, coalesce((tp / nullif(called, 0))::DOUBLE, 0) AS precision, coalesce((tp / nullif(actual, 0))::DOUBLE, 0) AS recall, coalesce((2 * tp / nullif(called + actual, 0))::DOUBLE, 0) AS f1
           FROM tp JOIN (SELECT predicted AS label, sum(n) AS called FROM m GROUP BY 1) USING (label))"""
_MCNEMAR = """CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1),
            lambda i: exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2))))) END AS p"""
_CURVE = _P + ", c AS (SELECT size, doc_id, CASE WHEN d2 >= 0.6 / size THEN 'good' ELSE 'bad' END = truth AS r FROM p, (VALUES (1), (2), (4), (8)) v(size))"

QUERIES = {f.__name__: f for f in (
    label_counts, length_stats, letter_counts, rates, confusion, class_scores, macro_f1, predicted_distribution, collapse, baseline_band, transitions, mcnemar,
    paired_predictions, weighted_loss, whitened, medians, distinct_check, max_tokens, adjacent_points, run_pairs, saturation, running_best, argmax_label,
    verdicts, acceptance, split_leakage, broken_references, recomputed_metrics, split_balance,
)}

ORACLES = {
    "label_counts": _P + " SELECT l.label, count(p.doc_id) AS n FROM (VALUES ('good'), ('bad'), ('unused')) l(label) LEFT JOIN p ON p.a = l.label GROUP BY 1",
    "length_stats": "SELECT lang, min(length(text)) AS min_length, max(length(text)) AS max_length, round_even(avg(length(text)), 2) AS mean_length FROM documents GROUP BY 1",
    "letter_counts": "SELECT " + ", ".join(f"count(*) FILTER (lang = '{x}') AS \"n_{x}\"" for x in ("en", "fr", "de", "es", "xx")) + " FROM documents",
    "rates": _P + " SELECT lang, count(*) AS n, avg(coalesce(a = truth, false)::INT) AS right_a_rate, avg((b = truth)::INT) AS right_b_rate, avg((a IS NOT DISTINCT FROM b)::INT) AS agree_rate FROM p GROUP BY 1",
    "confusion": _C + " SELECT truth, predicted, n FROM m",
    "class_scores": _C + " SELECT * FROM sc",
    "macro_f1": _C + " SELECT avg(f1) AS macro_f1 FROM sc",
    "predicted_distribution": _P + " SELECT coalesce(a, 'INVALID') AS label, count(*) AS n FROM p GROUP BY 1",
    "collapse": _P + """, c AS (SELECT b AS label, count(*) AS n, (count(*) / sum(count(*)) OVER ())::DOUBLE AS share FROM p GROUP BY 1)
        SELECT label, share, CASE WHEN share = 1 THEN 'total' WHEN share >= 0.9 THEN 'near' ELSE 'none' END AS collapse FROM c ORDER BY n DESC, label DESC LIMIT 1""",
    "baseline_band": _P + " SELECT lang, count(*) AS n, 0.5::DOUBLE AS expected, 0.5 - 1.96 * sqrt(0.25 / count(*)) AS low, 0.5 + 1.96 * sqrt(0.25 / count(*)) AS high FROM p GROUP BY 1",
    "transitions": _P + ", v AS (SELECT coalesce(a = truth, false) AS x, b = truth AS y FROM p) SELECT count(*) FILTER (NOT x AND y) AS wrong_to_right, count(*) FILTER (x AND NOT y) AS right_to_wrong, count(*) FILTER (x AND y) AS right_to_right, count(*) FILTER (NOT x AND NOT y) AS wrong_to_wrong FROM v",
    "mcnemar": _P + """, v AS (SELECT lang, count(*) FILTER (coalesce(a = truth, false) AND b <> truth) AS a_only, count(*) FILTER (NOT coalesce(a = truth, false) AND b = truth) AS b_only FROM p GROUP BY 1)
        SELECT lang, a_only, b_only, CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1),
            lambda i: exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2))))) END AS p FROM v""",
    "paired_predictions": _P + " SELECT doc_id, a, b AS b_b FROM p",
    "weighted_loss": _P + " SELECT lang, sum(d2 * n_tokens) / sum(n_tokens) AS mean_loss FROM p GROUP BY 1",
    "whitened": _P + ", m AS (SELECT avg(d2) AS m, var_pop(d2) AS v FROM p WHERE truth = 'good') SELECT doc_id, CASE WHEN truth = 'good' THEN (d2 - m) / sqrt(v + 1e-8) ELSE 0 END AS whitened FROM p, m",
    "medians": _P + " SELECT lang, quantile_cont(n_tokens, 0.5) AS median FROM p GROUP BY 1",
    "distinct_check": r"SELECT count(*) AS n, count(DISTINCT regexp_replace(text, '[\s\p{Z}]+', '', 'g')) AS n_distinct, count(*) = count(DISTINCT regexp_replace(text, '[\s\p{Z}]+', '', 'g')) AS unique FROM documents",
    "max_tokens": _P + " SELECT doc_id % 3 AS split, max(n_tokens) AS max_value FROM p GROUP BY 1",
    "adjacent_points": _CURVE + ", q AS (SELECT size, avg(r::INT) AS accuracy FROM c GROUP BY 1) SELECT * FROM (SELECT size, accuracy, lead(size) OVER (ORDER BY size) AS next_size, lead(accuracy) OVER (ORDER BY size) AS next_value FROM q) WHERE next_size IS NOT NULL",
    "run_pairs": _CURVE + """, v AS (SELECT x.size, count(*) FILTER (x.r AND NOT y.r) AS a_only, count(*) FILTER (NOT x.r AND y.r) AS b_only FROM c x JOIN c y ON y.size = x.size * 2 AND x.doc_id = y.doc_id GROUP BY 1)
        SELECT size, a_only, b_only, """ + _MCNEMAR + " FROM v",
    "saturation": _CURVE + """, v AS (SELECT x.size, count(*) FILTER (x.r AND NOT y.r) AS a_only, count(*) FILTER (NOT x.r AND y.r) AS b_only FROM c x JOIN c y ON y.size = x.size * 2 AND x.doc_id = y.doc_id GROUP BY 1),
        q AS (SELECT size, """ + _MCNEMAR + """ FROM v), f AS (SELECT max(size * 2) FILTER (p < 0.05) AS last, min(size) FILTER (p >= 0.05) AS flat FROM q)
        SELECT CASE WHEN flat IS NOT NULL THEN coalesce(last, flat) END AS saturation_size, flat AS first_flat_size FROM f""",
    "split_balance": """
        WITH r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('7:', doc_id::VARCHAR)), doc_id) AS r FROM documents),
        c AS (SELECT CASE WHEN r <= 10 THEN 'test' WHEN r <= 20 THEN 'val' ELSE 'train' END AS split, lang, count(*) AS n FROM r WHERE r <= 50 GROUP BY 1, 2)
        SELECT split, sum(n)::BIGINT AS n, min(n) = max(n) AND count(*) = 4 AS balanced, sum(n) % 4 = 0 AS whole FROM c GROUP BY 1""",
    "running_best": _P + ", l AS (SELECT doc_id, 1 - d2 AS loss, min(1 - d2) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p) SELECT doc_id, best IS NULL OR loss < best AS is_best FROM l",
    "argmax_label": _P + " SELECT doc_id, CASE WHEN d2 >= 0.3 THEN 'good' ELSE 'bad' END AS best FROM p",
    "verdicts": _P + " SELECT source, CASE WHEN avg((b = truth)::INT) > 0.5 + 1.96 * sqrt(0.25 / count(*)) THEN 'beats_random' ELSE 'not_distinguishable' END AS verdict FROM p GROUP BY 1",
    "acceptance": """
        SELECT 'ids are unique' AS "check", count(*) = count(DISTINCT doc_id) AS ok, '' AS detail FROM documents
        UNION ALL SELECT 'lengths agree', count(*) FILTER (length(text) <> n_chars) = 0, '' FROM documents
        UNION ALL SELECT 'languages are known', count(*) FILTER (lang NOT IN ('en', 'fr', 'de', 'es')) = 0, '' FROM documents
        UNION ALL SELECT 'no copies', count(*) = count(DISTINCT text), (count(*) - count(DISTINCT text))::VARCHAR FROM documents""",
    "split_leakage": r"""
        WITH k AS (SELECT DISTINCT doc_id % 3 AS i, md5(regexp_replace(text, '[\s\p{Z}]+', '', 'g')) AS k FROM documents), n(i, name) AS (VALUES (0, 'train'), (1, 'val'), (2, 'test'))
        SELECT nx.name AS a, ny.name AS b, x.k FROM k x JOIN k y ON x.k = y.k AND x.i < y.i JOIN n nx ON nx.i = x.i JOIN n ny ON ny.i = y.i""",
    "broken_references": "SELECT d.doc_id FROM documents d LEFT JOIN documents r ON r.doc_id = d.doc_id + 1 WHERE d.doc_id % 50 = 0 AND d.text IS DISTINCT FROM r.text",
    "recomputed_metrics": "SELECT doc_id, 'n_chars' AS \"column\" FROM documents WHERE doc_id % 100 = 0",
}
