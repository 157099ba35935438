"""WARC archives: writing with revisits and segments, and reading with reassembly.

Writing.  Pages with equal payloads are found by SHA-1 and length; the page with the
largest id carries the payload, the others become revisit records that refer
to it.  A response's block is an HTTP message in chunked transfer coding.  Blocks over
``segment_bytes`` are cut into segments: the first stays in the task's main
archive, continuation records go to a second one, so that reading has to bring them
together.  Each record is a gzip member of its own.

Reading.  Tasks stream over the members of an archive.  Whole records are decoded at
once; segments are grouped by their origin's record id, ordered by number,
checked for gaps and against the total length, joined, and then decoded like the
others.  A group is one record, so its size is that of a page.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import atomic_output, open_store, shared_dir, small_batches, stored

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(page: int, segment: int = 0) -> str:
    return f"<urn:page:{page}>" if not segment else f"<urn:page:{page}:{segment}>"


def page_of(record: str) -> int:
    return int(record.strip("<>").split(":")[2])


def chunked(payload: bytes, size: int = 8192) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(part), part) for i in range(0, len(payload), size) if (part := payload[i : i + size])]
    return b"".join(out) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes:
    """Body of a chunked message; ValueError where its framing is damaged or cut short."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:line].split(b";")[0].strip(), 16)
        at = line + 2
        if not size:
            return b"".join(out)  # trailers, if any, are not payload
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, rid: str, block: bytes, **headers: str | None) -> bytes:
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + rid.encode(), b"WARC-Date: " + DATE.encode()]
    lines += [f"WARC-{k.replace('_', '-')}: {v}".encode() for k, v in headers.items() if v is not None]
    lines += [b"Content-Type: application/http; msgtype=response" if kind in ("response", "revisit") else b"Content-Type: application/warc-fields", b"Content-Length: %d" % len(block)]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def page_records(page: int, url: str, payload: bytes, refers: int | None, segment_bytes: int) -> list[bytes]:
    """The page's record; if it is segmented, its continuation records follow."""
    target = urllib.parse.quote(url or f"urn:page:{page}", safe="%/:=&?~#+!$,;'@()*[]")
    digest = "sha1:" + base32_sha1(payload)
    if refers is not None:
        return [record("revisit", urn(page), HTTP + b"Content-Length: %d\r\n\r\n" % len(payload), Target_URI=target, Profile=REVISIT, Refers_To=urn(refers), Payload_Digest=digest)]
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        return [record("response", urn(page), block, Target_URI=target, Payload_Digest=digest)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [record("response", urn(page), parts[0], Target_URI=target, Payload_Digest=digest, Segment_Number="1")]
    for n, part in enumerate(parts[1:], 2):
        total = str(len(block)) if n == len(parts) else None
        out.append(record("continuation", urn(page, n), part, Target_URI=target, Segment_Origin_ID=urn(page), Segment_Number=str(n), Segment_Total_Length=total))
    return out


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    left = b""
    while True:
        left = left or stream.read(chunk)
        if not left:
            return
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            out.append(unpack.decompress(left))
            left = unpack.unused_data
            if not unpack.eof:
                left = stream.read(chunk)
                if not left:
                    raise ValueError("archive cut short")
        yield b"".join(out)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("record cut short")
    return headers, rest[:size]


def http_payload(block: bytes) -> tuple[bytes, dict[bytes, bytes]]:
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return (unchunk(body) if headers.get(b"transfer-encoding", b"").lower() == b"chunked" else body), headers


ROW = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, problem string"
_FIELDS = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])
SEGMENT = "origin string, segment int, total long, target_uri string, digest string, block binary"
_SEGMENT = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("target_uri", pa.string()), ("digest", pa.string()), ("block", pa.binary())])


def response_row(page: int, uri: str | None, digest: str | None, block: bytes | None, problem: str | None = None) -> tuple:
    payload = None
    if problem is None:
        try:
            payload, _ = http_payload(block)
        except ValueError as e:
            problem = str(e)
    found = base32_sha1(payload) if payload is not None else None
    if found and digest and digest != "sha1:" + found:
        problem = "digest differs"
    return page, uri, "response", None, None if payload is None else len(payload), found, payload, problem


def reassemble(parts: list[tuple[int, int | None, bytes]]) -> tuple[bytes | None, str | None]:
    """(block, problem) of the segments (number, total length, bytes) of one record, in any
    order; a segment that is there twice with the same bytes counts once."""
    parts = sorted({(n, t, b) for n, t, b in parts}, key=lambda x: (x[0], x[1] or -1))
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        return None, "segments missing or in conflict"
    if parts[-1][1] is None:
        return None, "last segment missing"
    block = b"".join(p[2] for p in parts)
    return (block, None) if len(block) == parts[-1][1] else (None, "total length differs")


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, least_revisit: int = 0, segment_bytes: int = 16384, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write one record per row; returns the manifest (folder, path, kind, records).

    Of rows with equal payloads of at least least_revisit bytes, the one with the largest id is
    the response.  Null html is an empty payload; a null url gets a urn; rows with a
    null id are left out; of repeated rows with the same id all are responses.
    """
    spark = pages.sparkSession
    small_batches(spark)
    d = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload")).where("id IS NOT NULL")
    d = d.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    lead = d.groupBy("digest", "size").agg(F.max("id").alias("lead"))
    d = d.join(lead, ["digest", "size"]).select("id", "url", "payload", F.when((F.col("id") != F.col("lead")) & (F.col("size") >= least_revisit), F.col("lead")).alias("refers"))
    folder = shared_dir(spark, "warc")
    store, root = open_store(folder)
    store.create_dir(root)

    def run(batches):
        store, root = open_store(folder)
        part, number, held = TaskContext.get().partitionId(), 0, {"main": [], "more": []}
        size = 0

        def flush():
            nonlocal number, size
            for kind, records in held.items():
                if records:
                    path = f"{root}/part-{part:06d}-{number:04d}-{kind}.warc.gz"
                    with atomic_output(store, path) as out:
                        out.write(record("warcinfo", f"<urn:file:{part}:{number}:{kind}>", b"format: WARC File Format 1.1\r\n"))
                        for r in records:
                            out.write(r)
                    yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([path]), pa.array([kind]), pa.array([len(records)], pa.int64())], names=["folder", "path", "kind", "records"])
                    held[kind] = []
            number, size = number + 1, 0

        for b in batches:
            for page, url, payload, refers in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                first, *more = page_records(page, url, payload, refers, segment_bytes)
                held["main"].append(first)
                held["more"] += more
                size += len(first) + sum(map(len, more))
                if size >= archive_bytes:
                    yield from flush()
        yield from flush()

    return stored(d.mapInArrow(run, "folder string, path string, kind string, records long"), "warc-manifest", False, folder)


#: What damaged archives and foreign records raise.
DAMAGE = (ValueError, KeyError, IndexError, zlib.error)


def _sound(stream, path: str) -> Iterator[tuple[dict[str, str] | None, bytes]]:
    """(headers, block) of the records of an archive; (None, what is wrong) for one that can't be read.
    Nothing can be found after a damaged gzip member, so it is the last."""
    found = members(stream)
    while True:
        try:
            raw = next(found)
        except StopIteration:
            return
        except DAMAGE as e:
            yield None, f"{path}: {e}".encode()
            return
        try:
            yield parse_record(raw)
        except DAMAGE as e:
            yield None, f"{path}: {e}".encode()


def _whole_row(h: dict[str, str], block: bytes) -> tuple | None:
    """The row of a record that is no segment; null for other kinds."""
    uri = h.get("warc-target-uri")
    if h["warc-type"] == "response":
        return response_row(page_of(h["warc-record-id"]), uri, h.get("warc-payload-digest"), block)
    if h["warc-type"] == "revisit":
        length = re.search(rb"\r\ncontent-length:\s*(\d+)", block, re.I)
        return page_of(h["warc-record-id"]), uri, "revisit", page_of(h["warc-refers-to"]), int(length[1]) if length else None, h["warc-payload-digest"].removeprefix("sha1:"), None, None
    return None


def _scan(want_segments: bool):
    """Segments, or the rows of whole records and of what can't be read, of the archives of a manifest."""

    def run(batches):
        schema = _SEGMENT if want_segments else _FIELDS
        rows, size = [], 0
        for b in batches:
            for folder, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, _ = open_store(folder)
                with store.open_input_stream(path, compression=None) as f:
                    for h, block in _sound(f, path):
                        row, problem = None, None if h else block.decode()
                        try:
                            number = h and h.get("warc-segment-number")
                            if h and want_segments and number:
                                total = h.get("warc-segment-total-length")
                                row = h.get("warc-segment-origin-id", h["warc-record-id"]), int(number), int(total) if total else None, h.get("warc-target-uri"), h.get("warc-payload-digest"), block
                            elif h and not want_segments and not number:
                                row = _whole_row(h, block)
                        except DAMAGE as e:
                            problem = f"{path}: {e}"
                        if problem and not want_segments:
                            row = None, None, None, None, None, None, None, problem
                        if row:
                            rows.append(row)
                            size += len(block)
                        if size >= 4 << 20:
                            yield _table(rows, schema)
                            rows, size = [], 0
        if rows:
            yield _table(rows, schema)

    return run


def _join_segments(t: pa.Table) -> pa.Table:
    segments, totals, uris, digests, blocks = (t.column(i).to_pylist() for i in range(1, 6))
    block, problem = reassemble(list(zip(segments, totals, blocks, strict=True)))
    origin = t.column(0)[0].as_py()
    try:
        page = page_of(origin)
    except DAMAGE:
        page, block, problem = None, None, f"foreign record {origin}"
    row = response_row(page, uris[0], next((d for d in digests if d), None), block, problem)
    return pa.Table.from_batches([_table([row], _FIELDS)])


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per response or revisit record: page_id, target_uri, record_type, refers_to,
    payload_bytes, payload_digest (base32 SHA-1), payload (null for revisits), and
    problem (null; else what is wrong with the record, whose payload is then null
    or does not fit its digest).  A record or archive that can't be read gives a row with nothing
    but its problem, and a segment that is lost with it one for its page.  An empty manifest gives no rows.
    Archives of continuations alone are read for segments only."""
    files = manifest.select("folder", "path", "kind").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4)
    whole = files.where("kind <> 'more'").mapInArrow(_scan(False), ROW)
    joined = files.mapInArrow(_scan(True), SEGMENT).groupBy("origin").applyInArrow(_join_segments, ROW)
    return whole.unionByName(joined)
