"""Resumable stages: a ledger of what has been computed, keyed by what it was computed from.

A stage is a function of the DataFrame before it.  Its key is a digest of the key before it, its name, its code and
its parameters; the first key is the input's fingerprint.  A stage's result is written to a folder of its own
attempt; then a small record appears under the stage's key in one rename, and only a stage with a record counts as
done.  So a driver that dies leaves whole stages and unnamed attempts, never half a result, and a rerun reads the stages
that are done.  Any change of input, code or parameters changes the keys from there on.

Folders may be in any store that Spark writes to.  Only names, sizes and counts reach the driver.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Stage = Callable[[DataFrame], DataFrame]


def _digest(*parts: str) -> str:
    return hashlib.sha256("\x00".join(parts).encode()).hexdigest()


def code_fingerprint(*code: ModuleType | Callable | str) -> str:
    """Digest of the sources of modules (packages with all their modules) and of functions' modules."""
    out = []
    for c in code:
        module = c if isinstance(c, ModuleType) else importlib.import_module(c if isinstance(c, str) else c.__module__)
        top = Path(module.__file__)
        files = sorted(top.parent.rglob("*.py")) if top.name == "__init__.py" else [top]
        out += [_digest(module.__name__, *(f"{f.relative_to(top.parent)}:{hashlib.sha256(f.read_bytes()).hexdigest()}" for f in files))]
    return _digest(*out)


def content_fingerprint(df: DataFrame) -> str:
    """Digest of a table's rows whatever their order and partitions: count and sums of two hashes of each row."""
    rows = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    h = df.select(F.xxhash64(rows).cast("decimal(38,0)").alias("a"), F.xxhash64(rows, F.lit(1)).cast("decimal(38,0)").alias("b"))
    r = h.agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    return _digest(df.schema.json(), str(r["n"]), str(r["a"]), str(r["b"]))


class Store:
    """A folder of any file system that the session knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder.rstrip("/")
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str) -> str | None:
        path = self._path(self.at(name))
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """The file appears under its name whole or not at all; of two writers one wins."""
        temp = self._path(self.at(f"{name}.{uuid.uuid4().hex[:8]}.part"))
        out = self.fs.create(temp, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(temp, self._path(self.at(name))):
            self.fs.delete(temp, False)
            if self.read(name) is None:
                raise OSError(f"{self.at(name)} can't be written")

    def files(self, name: str) -> dict[str, int]:
        """Sizes of the files in a folder; none if it is not there."""
        path = self._path(self.at(name))
        if not self.fs.exists(path):
            return {}
        return {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(path) if s.isFile() and not s.getPath().getName().startswith((".", "_"))}

    def names(self) -> list[str]:
        path = self._path(self.folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(self.at(name)), True)


def files_fingerprint(spark: SparkSession, df: DataFrame) -> str:
    """Digest of the names, sizes and times of the files that df scans: no row is read.  For inputs of many terabytes."""
    seen = []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        seen.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    return _digest(df.schema.json(), *seen)


@dataclass
class Done:
    """A stage of a run: whether its result was read (reused) or computed, its key, rows and seconds."""

    name: str
    key: str
    reused: bool
    rows: int
    seconds: float


@dataclass
class Run:
    """Result of the last stage, and what became of each."""

    result: DataFrame
    stages: list[Done] = field(default_factory=list)


def _committed(spark: SparkSession, store: Store, name: str, key: str) -> dict | None:
    """The record of a stage whose files are all there with their sizes; a damaged result is none."""
    raw = store.read(f"{name}-{key[:24]}.json")
    record = json.loads(raw) if raw else None
    return record if record and record["key"] == key and store.files(record["data"]) == record["files"] else None


def _load(spark: SparkSession, store: Store, record: dict) -> DataFrame:
    return spark.read.schema(StructType.fromJson(record["schema"])).parquet(store.at(record["data"]))


def run_stages(spark: SparkSession, folder: str, first: DataFrame, stages: Iterable[tuple[str, Stage]], *, fingerprint: str, code: str = "", params: dict[str, dict] | None = None, start_at: str | None = None, only: str | None = None) -> Run:
    """Apply stages to first one after the other, reading those that the ledger in folder has.

    fingerprint: of first, such as content_fingerprint() or files_fingerprint() give.  code: of what the stages call.
    params: of each stage by name, JSON values; they are part of its key.  start_at: this stage and those after it are
    computed anew.  only: just this one is, and the ones before it must be there.  Names are those of folders and
    must differ."""
    stages = list(stages)
    names = [n for n, _ in stages]
    if len(set(names)) < len(names) or any(not n or not n.replace("_", "").replace("-", "").isalnum() for n in names):
        raise ValueError("stages need different names of letters, digits, - and _")
    for wanted in (start_at, only):
        if wanted is not None and wanted not in names:
            raise ValueError(f"no stage {wanted}")
    store, key, df, out = Store(spark, folder), _digest(fingerprint), first, []
    anew = False
    for name, stage in stages:
        key = _digest(key, name, code, json.dumps((params or {}).get(name, {}), sort_keys=True, ensure_ascii=False))
        anew = name == only if only is not None else anew or name == start_at
        record = None if anew else _committed(spark, store, name, key)
        reused, began = record is not None, time.monotonic()
        if record is None:
            if only is not None and name != only:
                raise RuntimeError(f"stage {name} comes before {only} and is not there")
            record = _compute(spark, store, name, key, stage(df))
        df = _load(spark, store, record)
        out.append(Done(name, key, reused, record["rows"], time.monotonic() - began))
        if name == only:
            break
    return Run(df, out)


def _compute(spark: SparkSession, store: Store, name: str, key: str, df: DataFrame) -> dict:
    data = f"{name}-{key[:24]}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(store.at(data))
    rows = spark.read.schema(df.schema).parquet(store.at(data)).count()  # from the files' footers
    record = {"name": name, "key": key, "data": data, "rows": rows, "files": store.files(data), "schema": df.schema.jsonValue()}
    record_name = f"{name}-{key[:24]}.json"
    if store.read(record_name) is not None:
        store.remove(record_name)  # damaged, or computed anew
    store.publish(record_name, json.dumps(record, ensure_ascii=False))
    won = json.loads(store.read(record_name))
    if won["data"] != data:
        store.remove(data)
    return won


def prune(spark: SparkSession, folder: str) -> list[str]:
    """Remove attempts that no record names, as dead drivers leave them; not to be called while a run goes on."""
    store = Store(spark, folder)
    names = store.names()
    kept = {json.loads(store.read(n))["data"] for n in names if n.endswith(".json")}
    gone = [n for n in names if not n.endswith(".json") and n not in kept]
    for n in gone:
        store.remove(n)
    return gone
