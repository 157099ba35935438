"""Scans and sinks: JSON lines, CSV, manifests, checksums, evaluation results."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip, text

MESSAGE = "struct<role:string,content:string,reasoning_content:string,tools:string,tool_calls:string>"
CONVERSATION = f"conversations array<{MESSAGE}>"


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with an inferred schema; one pass more than read_conversations."""
    return spark.read.json(path)


def read_text_rows(spark: SparkSession, path: str) -> DataFrame:
    """{text} rows; numbers become their text, other columns are not read."""
    return spark.read.schema("text string").json(path)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Fixed nested schema; a malformed line is an error."""
    return spark.read.schema(CONVERSATION).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: rows with ``malformed`` true where the line is no JSON object, so that a funnel can count them."""
    s = T.StructType.fromDDL(schema).add("_corrupt", "string")
    parsed = F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    d = spark.read.text(path).where(strip("value") != "").select(parsed.alias("p")).select("p.*")
    return d.withColumn("malformed", F.col("_corrupt").isNotNull()).drop("_corrupt")


def first_lines(spark: SparkSession, path: str, lines: int) -> DataFrame:
    """(file, line, value) of the first lines, files in the order of their names, lines numbered from 0 over all.

    Files are taken in that order, twice as many each time, until they have enough lines, so a corpus is not
    read for its first lines.  Each split's lines are counted where they are; a split's place, file and offset, tells how
    many lines come before it, and a line's own place within its split is known to its task.  Nothing is sorted
    but the splits that begin within the first lines, of which there are at most that many."""
    files = sorted(spark.read.text(path).inputFiles())
    take = 1
    while True:
        some = files[:take]
        d = spark.read.text(some) if some else spark.createDataFrame([], "value string")
        meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")] if some else [F.lit("").alias("file"), F.lit(0).cast("long").alias("split")]
        d = d.select("value", *meta, F.monotonically_increasing_id().alias("mid"))
        splits = d.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("least"))
        starts = splits.withColumn("start", F.sum("n").over(W.orderBy("file", "split")) - F.col("n"))  # a row a split
        starts = pinned(starts)
        if take >= len(files) or starts.agg(F.sum("n")).first()[0] >= lines:
            break
        take *= 2
    near = starts.where(F.col("start") < lines).select(F.col("file").alias("_file"), F.col("split").alias("_split"), "least", "start")
    d = d.join(F.broadcast(near), (F.col("file") == F.col("_file")) & (F.col("split") == F.col("_split")))  # at most ``lines`` rows
    return d.withColumn("line", F.col("start") + F.col("mid") - F.col("least")).where(F.col("line") < lines).select("file", "line", "value")


def first_texts(spark: SparkSession, path: str, lines: int = 10_000) -> DataFrame:
    """The joined, non-empty contents of the conversations of the first lines; lines are
    counted before malformed ones are passed over."""
    c = F.from_json("value", CONVERSATION)["conversations"]
    contents = F.filter(F.transform(c, lambda m: m["content"]), lambda x: text(x) != "")
    return first_lines(spark, path, lines).select("file", "line", F.array_join(contents, "\n").alias("text")).where("text <> ''")


def read_csv_rows(spark: SparkSession, path: str, schema: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Quoted, multi-line CSV with a header; bytes that do not decode are replaced."""
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", encoding)
    return (r.schema(schema) if schema else r).csv(path)


def read_labelled(spark: SparkSession, files: dict[str, str], schema: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """One file per label, the label as a column."""
    out = None
    for label, path in files.items():
        d = read_csv_rows(spark, path, schema, encoding).withColumn("label", F.lit(label))
        out = d if out is None else out.unionByName(d)
    if out is None:
        raise ValueError("no files")
    return out


def read_questions(spark: SparkSession, sources: list[tuple[str, str, str]]) -> DataFrame:
    """(source, question, ord) of (name, kind, path); kinds jsonl_question, conversations, csv_question."""
    out = None
    for n, (name, kind, path) in enumerate(sources):
        if kind == "jsonl_question":
            d = spark.read.schema("question string").json(path).select(strip("question").alias("question"))
        elif kind == "conversations":
            d = spark.read.schema(CONVERSATION).json(path).select(strip(F.get("conversations", F.lit(0))["content"]).alias("question"))
        elif kind == "csv_question":
            d = read_csv_rows(spark, path).select(strip("Question").alias("question"))
        else:
            raise ValueError(f"unknown kind {kind}")
        d = d.where("question <> ''").select(F.lit(name).alias("source"), "question", F.lit(n).alias("ord"))
        out = d if out is None else out.union(d)
    return out


#: Bytes of a file that a task has in memory while it is digested.
CHUNK = 1 << 20
#: Stores whose files a worker opens by itself; files of others come through Spark, whole, up to its 2 GB a row.
STREAMED = ("file", "hdfs", "s3", "s3a", "gs")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5, sha256, length) of whole files; fetching them is not the engine's work.

    Files are dealt out one by one and go through a task in chunks, however long they are."""
    found = spark.read.format("binaryFile").load(path).inputFiles()  # addresses; of empty files too
    names = [(x,) for x in found if x.split(":", 1)[0] in STREAMED]
    others = [unquote(x) for x in found if x.split(":", 1)[0] not in STREAMED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                md5, sha256, length = hashlib.md5(usedforsecurity=False), hashlib.sha256(), 0
                store, at = pafs.FileSystem.from_uri(quote(name.replace("s3a:", "s3:", 1), safe="%/:@=&+,;!$()*~'"))
                with store.open_input_stream(at, compression=None) as stream:
                    while chunk := stream.read(CHUNK):
                        md5.update(chunk)
                        sha256.update(chunk)
                        length += len(chunk)
                shown = unquote(name).replace("file:///", "file:/", 1)  # as Spark writes paths
                yield pa.RecordBatch.from_pydict({"path": [shown], "md5": [md5.hexdigest()], "sha256": [sha256.hexdigest()], "length": [length]})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = spark.createDataFrame(names, "address string").repartition(n, "address")
    out = dealt.mapInArrow(run, "path string, md5 string, sha256 string, length long")
    if others:
        whole = spark.read.format("binaryFile").load(others)
        out = out.unionByName(whole.select("path", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), "length"))
    return out


def check_digests(digests: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (name, sha256) with ok; a missing file is not ok."""
    have = digests.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("found"))
    return expected.join(have, "name", "left").select("name", F.coalesce(F.col("sha256") == F.col("found"), F.lit(False)).alias("ok"))


def write_rows(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines without columns that start with an underscore; refuses to overwrite
    unless told; the committer shows the files only when all are whole."""
    temps = [c for c in df.columns if c.startswith("_")]
    df.drop(*temps).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def manifest(**aggregates: DataFrame) -> str:
    """One JSON document of small aggregates, a list of rows each; an error beyond MOST_ROWS."""
    return json.dumps({k: [r.asDict(recursive=True) for r in _few(d)] for k, d in aggregates.items()}, ensure_ascii=False, default=str, sort_keys=True)


#: Rows that a report or manifest may have of one table.
MOST_ROWS = 10_000


def _few(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"over {MOST_ROWS} rows are no aggregate for a report")
    return rows


def report(title: str, sections: dict[str, DataFrame | str], notes: list[str] | None = None) -> str:
    """A Markdown report: a title, then a heading for each section with its table or text, then notes."""
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts.append(f"## {name}\n\n{body if isinstance(body, str) else markdown_table(body)}")
    if notes:
        parts.append("\n".join(f"- {n}" for n in notes))
    return "\n\n".join(parts) + "\n"


def markdown_table(df: DataFrame) -> str:
    """A small result as a Markdown table; cells are escaped by functions.text.table_cell."""
    from ..functions.text import table_cell

    rows = df.select(*[table_cell(c).alias(c) for c in df.columns])
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(r) + " |" for r in _few(rows)])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for files that driver and executors share, under the session's checkpoint folder;
    a temporary one only on a local master.  It goes when the driver ends."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return path.toString()


def pinned(df: DataFrame) -> DataFrame:
    """df computed once, for plans that read it twice and need the same rows in the same places.

    Range partitions are cut at sampled bounds, which another evaluation may place otherwise.  A
    reliable checkpoint where the session has a folder for it, else the cache, whose lost parts
    come again from the same shuffle.  A checkpoint counts its rows and then writes them, so
    they are cached until it is there."""
    held = df.persist()
    if not df.sparkSession.sparkContext.getCheckpointDir():
        return held
    out = held.checkpoint()
    held.unpersist()
    return out


#: Bytes of files up to which a table is dealt out anew before work on its rows.
SMALL_TABLE = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, a scan, with the rows of a small table dealt to all cores.

    A row group is the least that a task reads, so a small file, which often is a single one, leaves all work on its
    rows to one core.  Larger tables have row groups for all cores and are left where they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_TABLE else df


def with_row_id(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Stable 0-based numbers in the order of columns.

    Range partitions are sorted and counted, and a number is a partition's offset and a
    place in it, so no task sees all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = pinned(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part, place = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND((1 << 33) - 1)
    sizes = d.select(part.alias("_part")).groupBy("_part").count().orderBy("_part").collect()  # one row per partition
    offsets, at = [], 0
    for r in sizes:
        offsets.append((r["_part"], at))
        at += r["count"]
    o = df.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    return d.withColumn("_part", part).join(F.broadcast(o), "_part").withColumn(name, place + F.col("_offset")).drop("_mid", "_part", "_offset")


def read_eval_runs(spark: SparkSession, runs: dict[str, tuple[str, str]], lines: bool = False) -> DataFrame:
    """(run, train_size, prediction columns) of each run's summary and report files.

    A report is an object with a list of predictions; with lines it is any number of such objects, one a
    line, so that a large run is read by many tasks."""
    out = None
    for name, (summary, report) in runs.items():
        s = spark.read.option("multiLine", True).json(summary).select(F.col("num_train").cast("long").alias("train_size"))
        s = s.agg(F.when(F.count(F.lit(1)) == 1, F.first("train_size")).otherwise(F.raise_error(F.lit("a summary is one object")).cast("long")).alias("train_size"))
        p = spark.read.option("multiLine", not lines).json(report).select(F.explode("predictions").alias("p")).select("p.*")
        d = p.join(F.broadcast(s)).withColumn("run", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
