"""Queries over documents, labels and benchmark, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup, filters, joins, sampling, sets, windows
from ..sources.io import pinned, spread

LANGS = ["en", "fr", "de", "es"]
#: Tables of texts, on whose rows queries do much work.
TEXTS = ("documents", "conversations")
#: SQL of functions.text on DuckDB, whose patterns name code points in braces.
SQL_WS = r"\s\p{Z}\x{85}\x{1c}-\x{1f}"
SQL_NORM = rf"regexp_replace(coalesce(text, ''), '[{SQL_WS}]+', '', 'g')"
SQL_STRIP = rf"regexp_replace(coalesce(text, ''), '^[{SQL_WS}]+|[{SQL_WS}]+$', '', 'g')"
SQL_BIGRAMS = "list_transform(range(1, length({t})), lambda i: substring({t}, i, 2))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def exact_dedup(s, d):
    k = docs(s, d).withColumn("_key", X.norm_space("text"))
    return dedup.keep_first(k, "_key", "doc_id").select("doc_id", "lang", "source")


def _reasons(frame: DataFrame) -> DataFrame:
    """(doc_id, reason): what a text shows by itself is told in one pass, and only flags and digests are joined."""
    flags = pinned(frame.select("doc_id", filters.long_enough("text", 8).alias("_long"), filters.hard_quality("text", ratio=0.2).alias("_hard"), F.sha2(X.norm_space("text").cast("binary"), 256).alias("_key")))
    first = flags.groupBy("_key").agg(F.min("doc_id").alias("_first"))
    reason = filters.first_reason([("too_short", ~F.col("_long")), ("low_quality", ~F.col("_hard")), ("duplicate", F.col("doc_id") > F.col("_first"))])
    return flags.join(first, "_key").select("doc_id", reason.alias("reason"))


ORDER = ["too_short", "low_quality", "duplicate"]


def quality_funnel(s, d):
    return filters.funnel(_reasons(docs(s, d)), "reason", ORDER)


def rejected_examples(s, d):
    return filters.examples(_reasons(docs(s, d)), "reason", "doc_id").select("doc_id", "reason")


def top_reasons(s, d):
    return sampling.top_reasons(_reasons(docs(s, d)), "reason")


_REASONS = f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {SQL_NORM} AS k FROM documents),
    b AS (SELECT *, {SQL_BIGRAMS.format(t="text")} AS g, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS rn FROM t),
    r AS (SELECT doc_id, CASE WHEN length(k) < 8 THEN 'too_short'
        WHEN length(text) < 30 OR (length(text) >= 50 AND len(list_distinct(g)) / len(g) < 0.2) THEN 'low_quality'
        WHEN rn > 1 THEN 'duplicate' END AS reason FROM b)"""


def text_keys(s, d):
    return docs(s, d).select("doc_id", F.md5(X.norm_space("text")).alias("space_key"), F.md5(X.norm_short("text")).alias("short_key"), F.md5(X.norm_long("text")).alias("long_key"), X.md5_key("text").alias("md5_key"))


def distinct2_score(s, d):
    return docs(s, d).select("doc_id", X.distinct2("text").alias("distinct2"))


def form_score(s, d):
    return docs(s, d).select("doc_id", X.form_score(F.lit("What does this passage say?"), "text", F.size(F.split("text", " "))).alias("score"))


def drop_bottom(s, d):
    return sampling.drop_bottom(docs(s, d).select("doc_id", X.distinct2("text").alias("score")), "score", "doc_id", 0.15)


def labelled(s, d):
    return docs(s, d).join(table(s, d, "labels"), "doc_id")


def contradiction_drop(s, d):
    x = labelled(s, d).select("doc_id", "quality", dedup.text_key("text").alias("key"))
    return dedup.drop_contradictions(pinned(x), "key", "quality", keyed=True).select("doc_id", "quality")


def merged_groups(s, d):
    k = labelled(s, d).withColumn("key", X.norm_word_key("text"))
    return dedup.merge_groups(k, "key", "quality", "doc_id").select("doc_id", "quality")


def exclusion_anti_join(s, d):
    entries = table(s, d, "labels").select(F.col("doc_id"), F.when(F.col("toxic") == 1, "exclude").otherwise("keep").alias("decision"), F.when(F.col("quality") == 1, "train").otherwise("all").alias("exclude_from"), F.md5(F.col("doc_id").cast("string")).alias("q_md5"))
    k = docs(s, d).select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("q_md5"))
    return joins.exclude(k, "q_md5", joins.exclusions(entries, "all"), joins.exclusions(entries, "train")).select("doc_id")


def still_valid(s, d):
    pins = table(s, d, "labels").where("quality = 1").select("doc_id")
    return joins.still_valid(pins, _reasons(docs(s, d)).where("reason IS NULL"), "doc_id")


def decontam_exact(s, d):
    b = table(s, d, "benchmark").select(F.md5(X.norm_long("text")).alias("k"))
    return joins.exclude(docs(s, d).select("doc_id", F.md5(X.norm_long("text")).alias("k")), "k", b).select("doc_id")


def decontam_contains(s, d):
    x = docs(s, d).select("doc_id", X.norm_space("text").alias("t"))
    b = table(s, d, "benchmark").select("item_id", X.norm_space("text").alias("t"))
    hit = joins.contained(x, "doc_id", "t", b, "item_id", "t")
    return hit.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def attribution(s, d):
    k = docs(s, d).select("doc_id", "source", F.md5(X.norm_space("text")).alias("k"))
    ext = k.select("k", "source", F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("ord"))
    return joins.attribute(k.select("doc_id", "k"), "k", ext).select("doc_id", "matched_source")


def split_overlap(s, d):
    k = docs(s, d).select(F.md5(X.norm_space("text")).alias("k"), (F.col("doc_id") % 3).alias("split"))
    return joins.overlap(k, "k", "split").select("k", "splits")


def locked_content(s, d):
    a, b = docs(s, d).select("doc_id", "text", "lang"), docs(s, d).select("doc_id", "text", F.when(F.col("doc_id") % 10 == 0, "xx").otherwise(F.col("lang")).alias("lang"))
    return joins.locked_join(a, b, "doc_id", ["text", "lang"]).select("doc_id", "intact")


def _grams(frame: DataFrame) -> DataFrame:
    return frame.select("doc_id", "lang", X.bigram_codes("text").alias("grams"))


def bigram_counts(s, d):
    g = docs(s, d).select("doc_id", X.bigram_sizes("text").alias("n"))
    return g.select("doc_id", *[F.col(f"n.{v}").alias(f"n_{v}") for v in X.GRAM_VARIANTS])


def neardup_pairs(s, d):
    """Pairs of texts that represent their equals in bigrams, and each other member with its representative."""
    pairs, members = dedup.similar_classes(_grams(docs(s, d)), "doc_id", "grams", 0.85)
    equal = members.where("row <> rep").select(F.col("rep").alias("a"), F.col("row").alias("b"), F.lit(1.0).alias("similarity"))
    return pairs.select("a", "b", "similarity").union(equal)


def neardup_greedy(s, d):
    return dedup.drop_near_duplicates(_grams(docs(s, d)), "doc_id", "grams").select("doc_id")


def neardup_in_label(s, d):
    return dedup.drop_near_duplicates(_grams(docs(s, d)), "doc_id", "grams", block=["lang"]).select("doc_id", "lang")


def neardup_external(s, d):
    b = table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), X.bigram_codes("text").alias("grams"))
    return dedup.drop_similar_to(_grams(docs(s, d)), "doc_id", "grams", b, 0.5).select("doc_id")


_PAIRS = f"""
    WITH t AS (SELECT doc_id, lang, {SQL_NORM} AS t FROM documents),
    g AS (SELECT doc_id, lang, unnest(list_distinct({SQL_BIGRAMS.format(t="t")})) AS g FROM t WHERE length(t) >= 2
          UNION ALL SELECT doc_id, lang, t FROM t WHERE length(t) = 1),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
    c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
    p AS (SELECT a, b, c / (x.n + y.n - c) AS similarity FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b),
    s AS (SELECT doc_id, string_agg(g, chr(1) ORDER BY g) AS s FROM g GROUP BY 1),
    m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS rep FROM s)"""
#: Rows in order, each of which goes if an earlier one that stayed is similar to it.
_GREEDY = """,
    e AS MATERIALIZED (SELECT b AS late, list(a) AS early, row_number() OVER (ORDER BY b) AS i FROM p WHERE similarity >= 0.85 {where} GROUP BY b),
    w(i, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
        SELECT w.i + 1, CASE WHEN len(list_filter(early, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, late) ELSE gone END FROM w JOIN e ON e.i = w.i + 1),
    z AS (SELECT unnest(gone) AS doc_id FROM (SELECT gone FROM w ORDER BY i DESC LIMIT 1))
    SELECT doc_id{columns} FROM documents WHERE doc_id IN (SELECT doc_id FROM n) AND doc_id NOT IN (SELECT doc_id FROM z)"""


def reservoir_per_group(s, d):
    return sampling.sample_per_group(docs(s, d).select("doc_id", "lang"), "lang", "doc_id", 50, 7).select("doc_id", "lang")


def seeded_sample(s, d):
    return sampling.sample(docs(s, d), "doc_id", 40, 7).select("doc_id")


def seeded_shuffle(s, d):
    return sampling.shuffled(docs(s, d).select("doc_id"), "doc_id", 7).select("doc_id", "position")


def epoch_batches(s, d):
    return sampling.batches(docs(s, d).select("doc_id"), "doc_id", 7, 1, 16, skip=3).select("doc_id", "batch")


def _drawn(s, d):
    return docs(s, d).select("doc_id", "lang", sampling.draw("doc_id", 7).alias("draw"))


def balanced_split(s, d):
    return windows.cursor_split(_drawn(s, d), "lang", ["draw", "doc_id"], [("test", 10), ("val", 10), ("train", 30)]).select("doc_id", "lang", "split")


def interleaved(s, d):
    x = windows.cursor_split(_drawn(s, d), "lang", ["draw", "doc_id"], [("train", 15)])
    return windows.round_robin(x, "lang", ["draw", "doc_id"], LANGS).select("doc_id", "lang", "position")


def nested_prefixes(s, d):
    x = interleaved(s, d)
    return windows.nested_prefixes(x, "position", [20, 40, 60], len(LANGS)).select("size", "doc_id")


def pinned_refill(s, d):
    kept = table(s, d, "labels").where("quality = 1 AND toxic = 1").select("doc_id")
    return sampling.refill(kept, docs(s, d).select("doc_id"), "doc_id", 60)


def sequential_ids(s, d):
    return filters.numbered(docs(s, d).select("doc_id"), ["doc_id"], "doc").select("doc_id", "id")


def rank_by_hash(s, d):
    return windows.ranked(_drawn(s, d), "lang", ["draw", "doc_id"]).select("doc_id", "lang", F.col("rank").cast("long").alias("rank"))


def set_checks(s, d):
    lab, x = table(s, d, "labels").select("doc_id"), docs(s, d).select("doc_id")
    parts = {"labels_not_documents": sets.not_subset(lab, x, "doc_id"), "documents_not_labels": sets.not_subset(x, lab, "doc_id"), "both": sets.common(x, lab, "doc_id"), "either": sets.union_keys("doc_id", x, lab)}
    out = None
    for name, p in parts.items():
        c = p.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"))
        out = c if out is None else out.union(c)
    return out


def table_cells(s, d):
    return docs(s, d).select("doc_id", F.md5(X.table_cell("text")).alias("cell_md5"))


def sentence_counts(s, d):
    return docs(s, d).select("doc_id", F.size(X.split_sentences("text")).alias("n_sentences"), F.size(X.split_clauses("text")).alias("n_clauses"))


_DRAW = "md5(concat('7:', doc_id::VARCHAR))"
_RANK = f"row_number() OVER (PARTITION BY lang ORDER BY {_DRAW}, doc_id)"
_ORD = "CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 END"
_SHORT, _LONG = "，。？！,.?!、的了吗呢吧啊", r"""，。？！,.?!、的了吗呢吧啊：:；;\-—_（）\(\)【】\[\]\"''“”‘’于在中为是有的"""

QUERIES = {f.__name__: f for f in (
    exact_dedup, quality_funnel, rejected_examples, top_reasons, text_keys, distinct2_score, form_score, drop_bottom, contradiction_drop, merged_groups,
    exclusion_anti_join, still_valid, decontam_exact, decontam_contains, attribution, split_overlap, locked_content, bigram_counts, neardup_pairs,
    neardup_greedy, neardup_in_label, neardup_external, reservoir_per_group, seeded_sample, seeded_shuffle, epoch_batches, balanced_split, interleaved,
    nested_prefixes, pinned_refill, sequential_ids, rank_by_hash, set_checks, table_cells, sentence_counts,
)}

ORACLES = {
    "exact_dedup": f"SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY {SQL_NORM} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1",
    "quality_funnel": _REASONS + """, c AS (SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1),
        s(stage, reason) AS (VALUES (0, 'too_short'), (1, 'low_quality'), (2, 'duplicate'), (3, 'kept')),
        j AS (SELECT stage, reason, coalesce(n, 0) AS dropped FROM s LEFT JOIN c USING (reason))
        SELECT stage::BIGINT AS stage, reason, dropped, CASE WHEN reason = 'kept' THEN dropped ELSE (sum(dropped) OVER () - sum(dropped) OVER (ORDER BY stage))::BIGINT END AS survivors FROM j""",
    "rejected_examples": _REASONS + " SELECT doc_id, reason FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS n FROM r WHERE reason IS NOT NULL) WHERE n <= 10",
    "top_reasons": _REASONS + " SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1",
    "text_keys": f"SELECT doc_id, md5({SQL_NORM}) AS space_key, md5(regexp_replace(coalesce(text, ''), '[{SQL_WS}{_SHORT}]', '', 'g')) AS short_key, md5(regexp_replace(coalesce(text, ''), '[{SQL_WS}{_LONG}]', '', 'g')) AS long_key, md5({SQL_STRIP}) AS md5_key FROM documents",
    "distinct2_score": f"SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 2 THEN 0.0::DOUBLE ELSE (len(list_distinct({SQL_BIGRAMS.format(t='text')})) / (length(text) - 1))::DOUBLE END AS distinct2 FROM documents",
    "form_score": rf"""
        WITH t AS (SELECT doc_id, {SQL_STRIP} AS a, len(string_split(text, ' ')) AS n FROM documents),
        b AS (SELECT *, CASE WHEN length(a) < 2 THEN 0.0 ELSE len(list_distinct({SQL_BIGRAMS.format(t='a')})) / (length(a) - 1) END AS d2,
              len(list_filter(string_split(a, chr(10)), lambda p: regexp_replace(p, '[{SQL_WS}]+', '', 'g') <> '')) AS paras FROM t)
        SELECT doc_id, (0.4 * least(greatest((d2 - 0.60) / 0.20, 0), 1)
            + 0.3 * CASE WHEN n BETWEEN 150 AND 480 THEN 1.0 WHEN n >= 80 AND n < 150 THEN n / 150 WHEN n > 480 AND n <= 512 THEN 1.0 - 0.4 * (n - 480) / 32 ELSE 0.4 END
            + 0.2 * (0.6 * CASE WHEN right(a, 1) IN ('。', '！', '？', '…', '）', ']', '"') THEN 1.0 ELSE 0 END + 0.4 * CASE WHEN paras >= 2 THEN 1.0 ELSE 0 END) + 0.1 * 1.0)::DOUBLE AS score FROM b""",
    "drop_bottom": f"""
        WITH s AS (SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 2 THEN 0.0::DOUBLE ELSE (len(list_distinct({SQL_BIGRAMS.format(t='text')})) / (length(text) - 1))::DOUBLE END AS score FROM documents)
        SELECT doc_id, score FROM (SELECT *, row_number() OVER (ORDER BY score, doc_id) - 1 AS r, floor(count(*) OVER () * 0.15) AS cut FROM s) WHERE r >= cut""",
    "contradiction_drop": f"WITH t AS (SELECT doc_id, quality, {SQL_NORM} AS k FROM documents JOIN labels USING (doc_id)) SELECT doc_id, quality FROM t WHERE k NOT IN (SELECT k FROM t GROUP BY k HAVING count(DISTINCT quality) > 1)",
    "exclusion_anti_join": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "still_valid": _REASONS + " SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IN (SELECT doc_id FROM r WHERE reason IS NULL)",
    "decontam_exact": f"SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE regexp_replace(b.text, '[{SQL_WS}{_LONG}]', '', 'g') = regexp_replace(coalesce(d.text, ''), '[{SQL_WS}{_LONG}]', '', 'g'))",
    "decontam_contains": f"WITH d AS (SELECT doc_id, {SQL_NORM} AS t FROM documents), b AS (SELECT item_id, {SQL_NORM} AS t FROM benchmark) SELECT doc_id, item_id FROM d JOIN b ON contains(d.t, b.t) AND b.t <> ''",
    "attribution": f"WITH k AS (SELECT doc_id, source, {SQL_NORM} AS k, regexp_extract(source, '(\\d+)', 1)::INT AS ord FROM documents) SELECT doc_id, first_value(source) OVER (PARTITION BY k ORDER BY ord) AS matched_source FROM k",
    "split_overlap": f"SELECT md5({SQL_NORM}) AS k, count(DISTINCT doc_id % 3) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1",
    "locked_content": "SELECT doc_id, NOT (doc_id % 10 = 0 AND lang <> 'xx') AS intact FROM documents",
    "bigram_counts": rf"""
        WITH t AS (SELECT doc_id, {SQL_NORM} AS s, regexp_replace(coalesce(text, ''), '[{SQL_WS}{_LONG}]', '', 'g') AS l, {SQL_STRIP} AS r FROM documents)
        SELECT doc_id, (CASE WHEN s = '' THEN 0 WHEN length(s) < 2 THEN 1 ELSE len(list_distinct({SQL_BIGRAMS.format(t='s')})) END)::INT AS n_space,
            (CASE WHEN length(l) < 3 THEN 1 ELSE len(list_distinct({SQL_BIGRAMS.format(t='l')})) END)::INT AS n_long,
            (CASE WHEN l = '' THEN 0 WHEN length(l) < 3 THEN 1 ELSE len(list_distinct({SQL_BIGRAMS.format(t='l')})) END)::INT AS n_curated,
            (CASE WHEN length(r) < 2 THEN 1 ELSE len(list_distinct({SQL_BIGRAMS.format(t='r')})) END)::INT AS n_raw FROM t""",
    "neardup_pairs": _PAIRS + """ SELECT a, b, similarity::DOUBLE AS similarity FROM p JOIN m x ON x.doc_id = a AND x.rep = a JOIN m y ON y.doc_id = b AND y.rep = b WHERE similarity >= 0.85
        UNION ALL SELECT rep, doc_id, 1.0 FROM m WHERE rep <> doc_id""",
    "neardup_greedy": _PAIRS.replace("WITH", "WITH RECURSIVE", 1) + _GREEDY.format(where="", columns=""),
    "neardup_in_label": _PAIRS.replace("WITH", "WITH RECURSIVE", 1) + _GREEDY.format(where="AND (SELECT lang FROM documents WHERE doc_id = a) IS NOT DISTINCT FROM (SELECT lang FROM documents WHERE doc_id = b)", columns=", lang"),
    "neardup_external": f"""
        WITH t AS (SELECT 'd' AS k, doc_id AS id, {SQL_NORM} AS t FROM documents UNION ALL SELECT 'b', item_id, {SQL_NORM} FROM benchmark),
        g AS (SELECT k, id, unnest(list_distinct({SQL_BIGRAMS.format(t="t")})) AS g FROM t WHERE length(t) >= 2 UNION ALL SELECT k, id, t FROM t WHERE length(t) = 1),
        n AS (SELECT k, id, count(*) AS n FROM g GROUP BY 1, 2),
        c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.k = 'd' AND y.k = 'b' GROUP BY 1, 2)
        SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT a FROM c JOIN n x ON x.k = 'd' AND x.id = a JOIN n y ON y.k = 'b' AND y.id = b WHERE c / (x.n + y.n - c) >= 0.5)""",
    "merged_groups": r"""
        WITH t AS (SELECT doc_id, quality, lower(regexp_replace(nfc_normalize(text), '[^\p{L}\p{M}\p{N}_]+', '', 'g')) AS k FROM documents JOIN labels USING (doc_id)),
        g AS (SELECT k, min(doc_id) AS doc_id FROM t WHERE k <> '' GROUP BY 1 HAVING min(quality) IS NOT DISTINCT FROM max(quality))
        SELECT doc_id, quality FROM g JOIN t USING (doc_id)""",
    "sentence_counts": "SELECT doc_id, " + ", ".join(f"len(list_filter(regexp_extract_all(coalesce(text, ''), '[^{signs}]*[{signs}]|[^{signs}]+$'), lambda x: regexp_replace(x, '[{SQL_WS}]+', '', 'g') <> ''))::INT AS {name}" for name, signs in (("n_sentences", "。！？!?"), ("n_clauses", "，、；;：:,"))) + " FROM documents",
    "reservoir_per_group": f"SELECT doc_id, lang FROM (SELECT doc_id, lang, {_RANK} AS r FROM documents) WHERE r <= 50",
    "seeded_sample": f"SELECT doc_id FROM documents ORDER BY {_DRAW}, doc_id LIMIT 40",
    "seeded_shuffle": f"SELECT doc_id, row_number() OVER (ORDER BY {_DRAW}, doc_id) - 1 AS position FROM documents",
    "epoch_batches": "SELECT doc_id, batch FROM (SELECT doc_id, ((row_number() OVER (ORDER BY md5(concat('7:1:', doc_id::VARCHAR)), doc_id) - 1) // 16)::BIGINT AS batch FROM documents) WHERE batch >= 3",
    "balanced_split": f"SELECT doc_id, lang, CASE WHEN r <= 10 THEN 'test' WHEN r <= 20 THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, lang, {_RANK} AS r FROM documents) WHERE r <= 50",
    "interleaved": f"SELECT doc_id, lang, (r - 1) * 4 + {_ORD} AS position FROM (SELECT doc_id, lang, {_RANK} AS r FROM documents) WHERE r <= 15",
    "nested_prefixes": f"WITH p AS (SELECT doc_id, (r - 1) * 4 + {_ORD} AS position FROM (SELECT doc_id, lang, {_RANK} AS r FROM documents) WHERE r <= 15) SELECT size, doc_id FROM p, (VALUES (20), (40), (60)) AS v(size) WHERE position < size",
    "pinned_refill": "SELECT doc_id FROM (SELECT doc_id, 0 AS prio FROM labels WHERE quality = 1 AND toxic = 1 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 1)) ORDER BY prio, doc_id LIMIT 60",
    "sequential_ids": "SELECT doc_id, printf('doc_%05d', row_number() OVER (ORDER BY doc_id)) AS id FROM documents",
    "rank_by_hash": f"SELECT doc_id, lang, {_RANK} AS rank FROM documents",
    "set_checks": """
        SELECT 'labels_not_documents' AS "check", count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
        UNION ALL SELECT 'documents_not_labels', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL SELECT 'both', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
        UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)""",
    "table_cells": "SELECT doc_id, md5(" + "replace(" * 13 + "coalesce(text, '')" + "".join(f", {a}, '{b}')" for a, b in [("'&'", "&amp;"), ("'<'", "&lt;"), ("'>'", "&gt;"), ("chr(13) || chr(10)", "\n"), ("chr(13)", "\n"), ("'\\'", "&#92;"), ("'|'", "&#124;"), ("'`'", "&#96;"), ("'*'", "&#42;"), ("'_'", "&#95;"), ("'['", "&#91;"), ("']'", "&#93;"), ("chr(10)", "<br>")]) + ") AS cell_md5 FROM documents",
}
