"""Queries that write the driver's tables in each format and read them back, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.chat import gather_turns
from ..operators import aggregates, joins, validation, windows
from ..sources import io
from ..sources.io import pinned
from .curation import SQL_STRIP, docs, table


def _md5(c: str):
    return F.md5(X.text(c).cast("binary")).alias("text_md5")


def scan_json_rows(s, d):
    """Columns with an underscore stay out, types are inferred."""
    path = io.scratch(s, "json") + "/rows"
    io.write_rows(docs(s, d).select("doc_id", "text", "lang", F.lit(1).alias("_work")), path)
    x = io.read_json_rows(s, path)
    return x.select("doc_id", "lang", _md5("text"), F.lit(",".join(x.columns)).alias("columns"))


def scan_text_rows(s, d):
    """S1"""
    path = io.scratch(s, "text") + "/rows"
    io.write_rows(docs(s, d).select("doc_id", "text"), path)
    return io.read_text_rows(s, path).groupBy(_md5("text")).agg(F.count(F.lit(1)).alias("n"))


def scan_conversations(s, d):
    """The nested schema, and digests of the contents in order."""
    path = io.scratch(s, "conversations") + "/rows"
    io.write_rows(gather_turns(table(s, d, "conversations")).select(F.col("messages").alias("conversations")), path)
    x = io.read_conversations(s, path).select(F.size("conversations").alias("turns"), F.md5(F.array_join(F.transform("conversations", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").cast("binary")).alias("md5"))
    return x.groupBy("md5", "turns").agg(F.count(F.lit(1)).alias("n"))


def scan_tolerant(s, d):
    """S3: a seventh of the lines cut off, a seventh no object, some blank."""
    path = io.scratch(s, "tolerant") + "/rows"
    line, k = F.to_json(F.struct("doc_id", "lang")), F.col("doc_id") % 7
    docs(s, d).select(F.when(k == 0, F.substr(line, F.lit(1), F.length(line) - 3)).when(k == 1, F.concat(F.lit('"'), "lang", F.lit('"'))).when(k == 2, F.concat(line, F.lit("\n  "))).otherwise(line).alias("value")).write.text(path)
    return io.read_tolerant(s, path, "doc_id long, lang string").groupBy("malformed", F.when(~F.col("malformed"), F.col("lang")).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col("malformed"), F.col("doc_id"))).alias("ids"))


def scan_first_texts(s, d):
    """The texts of the first half of the lines of several files, of which every third is damaged."""
    path = io.scratch(s, "first") + "/rows"
    x = gather_turns(table(s, d, "conversations"))
    line = F.to_json(F.struct(F.col("messages").alias("conversations")))
    x = x.select("conv_id", F.when(F.col("conv_id") % 3 == 2, F.lit("{")).otherwise(line).alias("value"))
    x.repartitionByRange(5, "conv_id").sortWithinPartitions("conv_id").select("value").write.text(path)
    return io.first_texts(s, path, x.count() // 2).select(_md5("text"))


def _csv(s, d, df: DataFrame, name: str) -> str:
    path = io.scratch(s, name) + "/rows"
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def scan_csv(s, d):
    """Texts with line ends, commas and quotes."""
    path = _csv(s, d, docs(s, d).select("doc_id", F.concat(F.lit('"a", '), X.text("text")).alias("text"), "lang"), "csv")
    return io.read_csv_rows(s, path, "doc_id long, text string, lang string").select("doc_id", "lang", _md5("text"))


def scan_labelled(s, d):
    """S6"""
    files = {x: _csv(s, d, docs(s, d).where(F.col("lang") == x).select("doc_id", "source"), f"csv-{x}") for x in ("en", "fr", "de")}
    return io.read_labelled(s, files, "doc_id long, source string").select("doc_id", "source", "label")


def scan_questions(s, d):
    """The three kinds of question files; blank questions go."""
    x = docs(s, d).select("doc_id", F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(X.text("text")).alias("question"))
    folder = io.scratch(s, "questions")
    io.write_rows(x.where("doc_id % 3 = 0").select("question"), f"{folder}/a")
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")))
    io.write_rows(x.where("doc_id % 3 = 1").select(turns.alias("conversations")), f"{folder}/b")
    c = _csv(s, d, x.where("doc_id % 3 = 2").select(F.col("question").alias("Question")), "questions-csv")
    q = io.read_questions(s, [("a", "jsonl_question", f"{folder}/a"), ("b", "conversations", f"{folder}/b"), ("c", "csv_question", c)])
    return q.groupBy("source", "ord", _md5("question")).agg(F.count(F.lit(1)).alias("n"))


def scan_digests(s, d):
    """Digests of sixteen files of ids, found again, missed and found changed."""
    path = io.scratch(s, "digests") + "/rows"
    x = docs(s, d).select("doc_id", (F.col("doc_id") % 16).alias("k"))
    x.repartition("k").sortWithinPartitions("k", "doc_id").select("k", F.col("doc_id").cast("string").alias("value")).write.partitionBy("k").text(path)
    x = pinned(io.file_digests(s, path + "/*/*.txt"))
    name = F.element_at(F.split("path", "/"), -1)
    at = x.select(F.concat_ws("/", F.element_at(F.split("path", "/"), -2), name).alias("path"), "sha256")
    expected = at.select(F.col("path").alias("name"), "sha256").union(at.select(F.concat("path", F.lit("?")), "sha256")).union(at.select("path", F.lit("0")))
    ok = io.check_digests(at.withColumn("path", F.replace("path", F.lit("/"), F.lit("|"))), expected.withColumn("name", F.replace("name", F.lit("/"), F.lit("|")))).agg(F.count_if("ok").alias("found"), F.count_if(~F.col("ok")).alias("failed"))
    return x.select("md5", "sha256", "length").crossJoin(F.broadcast(ok))  # one row


def scan_guard(s, d):
    """A second write to a folder is refused and the first one's rows stay."""
    path = io.scratch(s, "guard") + "/rows"
    io.write_rows(docs(s, d).select("doc_id"), path)
    try:
        io.write_rows(docs(s, d).limit(1).select("doc_id"), path)
        refused = False
    except Exception as e:  # noqa: BLE001  the engine's own error
        refused = "ALREADY_EXISTS" in str(e)
    return s.read.schema("doc_id long").json(path).agg(F.count(F.lit(1)).alias("n"), F.lit(refused).alias("refused"))


def scan_manifest(s, d):
    """A manifest's rows read again, and whether the report has each as a line of its table."""
    c = aggregates.count_labels(docs(s, d), "lang", ["en", "fr", "xx"]).select("label", "n")
    rows = json.loads(io.manifest(languages=c))["languages"]
    lines = io.report("Languages", {"Rows": c, "Text": "none"}, ["a note"]).split("\n")
    return s.createDataFrame([(r["label"], r["n"], f"| {r['label']} | {r['n']} |" in lines and lines[0] == "# Languages" and "- a note" in lines) for r in rows], "label string, n long, reported boolean")


def scan_eval_runs(s, d):
    """A run for each quality, from its summary and its report."""
    folder, x = io.scratch(s, "runs"), table(s, d, "labels")
    runs = {}
    for q in (0, 1):
        part = x.where(F.col("quality") == q)
        part.agg(F.count(F.lit(1)).alias("num_train")).coalesce(1).write.json(f"{folder}/{q}/summary")
        lists = part.groupBy(F.floor(F.col("doc_id") / 1000)).agg(F.collect_list(F.struct("doc_id", "toxic")).alias("predictions"))  # 1000 ids each
        lists.select("predictions").write.json(f"{folder}/{q}/report")
        runs[f"run{q}"] = (f"{folder}/{q}/summary", f"{folder}/{q}/report")
    return io.read_eval_runs(s, runs, lines=True).select("run", "train_size", "doc_id", "toxic")


def zipped(s, d):
    """Predictions of two runs, place by place."""
    x = table(s, d, "labels")
    return joins.zip_rows(x.select("doc_id", "quality"), x.select("doc_id", "toxic"), "doc_id", ["doc_id"], ["doc_id"]).select("place", "doc_id", "quality", "b_toxic")


def share_split(s, d):
    """42 rows for dev and 90 for train, by language."""
    sizes = windows.share_sizes([("dev", 42), ("train", 90)], 4)
    return windows.cursor_split(docs(s, d).select("doc_id", "lang"), "lang", ["doc_id"], sizes).select("doc_id", "lang", "split")


def comparison_gate(s, d):
    """V5: the second run lacks a row, has another one's text, and differs in one setting and one digest."""
    x = docs(s, d).select("doc_id", "text", "lang")
    second = x.where("doc_id <> 7").withColumn("text", F.when(F.col("doc_id") % 100 == 3, "other").otherwise(F.col("text")))
    return validation.comparison_gate(x, second, x, "doc_id", ["text", "lang"], ({"split": "test", "seed": 1}, {"split": "test", "seed": 2}), ["split", "seed", "model"], {"data": ("a", "a"), "weights": (None, "b")})


QUERIES = {f.__name__: f for f in (
    scan_json_rows, scan_text_rows, scan_conversations, scan_tolerant, scan_first_texts, scan_csv, scan_labelled, scan_questions, scan_digests, scan_guard, scan_manifest,
    scan_eval_runs, zipped, share_split, comparison_gate,
)}

_TURNS = "string_agg(role || ':' || coalesce(text, ''), '|' ORDER BY turn)"
ORACLES = {
    "scan_json_rows": "SELECT doc_id, lang, md5(coalesce(text, '')) AS text_md5, 'doc_id,lang,text' AS columns FROM documents",
    "scan_text_rows": "SELECT md5(coalesce(text, '')) AS text_md5, count(*) AS n FROM documents GROUP BY 1",
    "scan_conversations": f"SELECT md5(m) AS md5, turns, count(*) AS n FROM (SELECT {_TURNS} AS m, count(*)::INT AS turns FROM conversations GROUP BY conv_id) GROUP BY 1, 2",
    "scan_tolerant": "SELECT doc_id % 7 < 2 AS malformed, CASE WHEN doc_id % 7 >= 2 THEN lang END AS lang, count(*) AS n, sum(CASE WHEN doc_id % 7 >= 2 THEN doc_id END)::BIGINT AS ids FROM documents GROUP BY 1, 2",
    "scan_first_texts": """
        WITH c AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (text <> '') AS t, row_number() OVER (ORDER BY conv_id) AS line FROM conversations GROUP BY 1)
        SELECT md5(t) AS text_md5 FROM c WHERE line <= (SELECT count(*) // 2 FROM c) AND conv_id % 3 <> 2 AND t <> ''""",
    "scan_csv": "SELECT doc_id, lang, md5('\"a\", ' || coalesce(text, '')) AS text_md5 FROM documents",
    "scan_labelled": "SELECT doc_id, source, lang AS label FROM documents WHERE lang IN ('en', 'fr', 'de')",
    "scan_questions": f"SELECT chr((97 + doc_id % 3)::INT) AS source, (doc_id % 3)::INT AS ord, md5(q) AS text_md5, count(*) AS n FROM (SELECT doc_id, {SQL_STRIP} AS q FROM documents WHERE doc_id % 11 <> 0) WHERE q <> '' GROUP BY 1, 2, 3",
    "scan_digests": """
        SELECT md5(t) AS md5, sha256(t) AS sha256, strlen(t) AS length, count(*) OVER () AS found, 2 * count(*) OVER () AS failed
        FROM (SELECT string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id) || chr(10) AS t FROM documents GROUP BY doc_id % 16)""",
    "scan_guard": "SELECT count(*) AS n, true AS refused FROM documents",
    "scan_manifest": "SELECT l.label, count(doc_id) AS n, true AS reported FROM (VALUES ('en'), ('fr'), ('xx')) l(label) LEFT JOIN documents ON lang = l.label GROUP BY 1",
    "scan_eval_runs": "SELECT 'run' || quality AS run, count(*) OVER (PARTITION BY quality) AS train_size, doc_id, toxic FROM labels",
    "zipped": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, doc_id, quality, toxic AS b_toxic FROM labels",
    "share_split": "SELECT doc_id, lang, CASE WHEN r <= 11 THEN 'dev' ELSE 'train' END AS split FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 33",
    "comparison_gate": """
        WITH n AS (SELECT count(*) FILTER (doc_id = 7) AS lacks, count(*) FILTER (doc_id % 100 = 3 AND doc_id <> 7 AND text IS DISTINCT FROM 'other') AS differ FROM documents)
        SELECT "check", ok, detail FROM (VALUES ('setting split', true, chr(39) || 'test' || chr(39) || ', ' || chr(39) || 'test' || chr(39)), ('setting seed', false, '1, 2'), ('setting model', false, 'None, None'), ('digest data', true, ''), ('digest weights', false, ''),
            ('first run covers the set', true, '0'), ('first run has no other rows', true, '0'), ('first run has no row twice', true, '0'), ('first run has the locked content', true, '0'),
            ('second run has no other rows', true, '0'), ('second run has no row twice', true, '0')) v("check", ok, detail)
        UNION ALL SELECT 'second run covers the set', lacks = 0, lacks::VARCHAR FROM n UNION ALL SELECT 'second run has the locked content', differ = 0, differ::VARCHAR FROM n""",
}
