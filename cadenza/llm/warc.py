"""WARC archives with an index written first.

Every task appends its records, a gzip member each, to a file of its own in a shared folder and yields the index rows: file, offset, length, URL, digest.
Spark commits the index, so only files of successful attempts are ever named in it; what a lost attempt left is never read. Reading deals the selected
index rows out by place, joins neighbouring byte ranges into one read and parses the records.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path

SMALLEST_REVISIT, FILE_BYTES, GAP_BYTES, READ_BYTES, TASK_BYTES, LEVEL, FEW_BYTES = 100, 256 << 20, 64 << 10, 16 << 20, 128 << 20, 1, 16 << 20
INDEX = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, file string, offset bigint, length bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
#: What stands for a missing URL, as a record has to name one.
NO_URL = "about:blank"


def _line(text) -> str:
    """A header value: line ends in it would end the header."""
    return "".join(c if c.isprintable() else "%" + format(ord(c), "02X") for c in str(text))


def record_bytes(page_id, url, kind, refers_to, refers_url, size, digest, payload: bytes, record_id: str, date: str) -> bytes:
    """A WARC 1.0 record. A response holds an HTTP message with the payload as its body; a revisit holds nothing and names the response's URL and date."""
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url or NO_URL)}", f"WARC-Payload-Digest: sha256:{digest}"]
    block = b""
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {_line(refers_url or NO_URL)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {refers_to}"]
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        head.append("Content-Type: application/http; msgtype=response")
    head += [f"X-Page-Id: {page_id}"] * (page_id is not None) + [f"X-No-Url: {'null' if url is None else 'empty'}"] * (not url)
    head += [f"X-Payload-Length: {size}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.0":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't fit its header")
    return fields, rest[:size]


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def plan_records(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> page_id, url, payload (binary), payload_digest, record_type, refers_to, refers_url.

    Null html is an empty payload. Of equal payloads of SMALLEST_REVISIT bytes or more, the one with the smallest page_id (null: largest) is the
    response; if that id is there several times, all its rows are. Only minima per digest are shuffled for finding it, combined first. Digests that come more than once
    meet the pages where they lie, if they and their URLs take no more than FEW_BYTES; beyond that payloads are shuffled for a join that adaptive execution splits.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    first = rows.where(F.col("size") >= SMALLEST_REVISIT).groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.min("page_id").alias("id"), F.count("*").alias("copies"))
    first = first.where("copies > 1").select("payload_digest", F.col("id").alias("first"), F.col("first")["url"].alias("first_url"))
    first = materialize(first, "repeated")
    size = first.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("first_url")), F.lit(0)).alias("urls")).first()
    first = F.broadcast(first) if 100 * size["n"] + size["urls"] <= FEW_BYTES else first
    rows = rows.join(first, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.select(
        "page_id", "url", "payload", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"),
    )


def write_archives(pages: DataFrame, folder: str | None = None, date: str | None = None) -> DataFrame:
    """Write all pages as WARC records and return the index, itself a table in the shared folder. An empty table makes an empty index and no files.

    ``folder`` is a URI of a file system that pyarrow knows as well as Spark; ``date`` (ISO, default: now) is that of every record.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    payload, kind = r["payload"], r["record_type"]
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        store.create_dir(base, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    packer, record_id = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{at}")
                    data = record_bytes(r["page_id"], r["url"], kind, r["refers_to"], r["refers_url"], len(payload), r["payload_digest"], payload, record_id, date)
                    data = packer.compress(data) + packer.flush()
                    out.write(data)
                    rows.append({k: r[k] for k in ("page_id", "url", "record_type", "refers_to", "payload_digest")} | {"file": f"{folder}/{name}", "offset": at, "length": len(data)})
                    at += len(data)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_arrow(INDEX))
        finally:
            if out is not None:
                out.close()

    return materialize(plan_records(pages).mapInArrow(run, INDEX), "warc-index")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def ranges(places: Iterable[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Reads that cover ``places`` (file, offset, length), which come in order: file, start, end, the places' offsets and lengths; gaps of GAP_BYTES are read over."""
    file, start, end, held = None, 0, 0, []
    for f, a, n in places:
        if held and (f != file or a > end + GAP_BYTES or a + n - start > READ_BYTES):
            yield file, start, end, held
            held = []
        if not held:
            file, start, end = f, a, a
        held.append((a, n))
        end = max(end, a + n)
    if held:
        yield file, start, end, held


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records that ``index`` (all of it, or a selection) names, read back from the archives.

    Columns: page_id, url, record_type, refers_to, payload_bytes and payload_digest (of the full payload, for revisits too), payload (what the record
    itself holds; null if not asked for). A digest that doesn't fit the bytes fails the job. No rows: no rows. Rows repeat as in ``index``.

    Index rows are dealt out by file and offset, about TASK_BYTES of archive a task, so that each task reads a stretch of its own.
    """
    wanted = index.select("file", "offset", "length")
    total = wanted.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = max(1, min(total[0], max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total[1] / TASK_BYTES))))
    wanted = wanted.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches):
        name, source, schema = None, None, _arrow(RECORD)
        for file, start, end, held in ranges(place for b in batches for place in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)):
            if file != name:
                if source is not None:
                    source.close()
                store, path = _store(file)
                name, source = file, store.open_input_file(path)
            data, made = source.read_at(end - start, start), []
            for offset, length in held:
                fields, block = parse_record(zlib.decompress(data[offset - start : offset - start + length], 31))
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                body = block.partition(b"\r\n\r\n")[2]
                if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                    raise ValueError("a payload doesn't fit its digest")
                number = [int(fields[k]) if k in fields else None for k in ("X-Page-Id", "X-Refers-To-Page")]
                url = {"null": None, "empty": ""}[fields["X-No-Url"]] if "X-No-Url" in fields else fields["WARC-Target-URI"]
                made.append((number[0], url, kind, number[1], int(fields["X-Payload-Length"]), digest, body if payload else None))
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate(schema.types)], schema=schema)
        if source is not None:
            source.close()

    return wanted.mapInArrow(run, RECORD)
