"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. The reader cuts files into byte ranges; a task looks
for gzip magic in its range, decodes the start of each candidate to see whether a WARC header is
there, and owns the records that start inside, reading the last one past the range's end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import materialize, new_path, task_partitions
from .batches import file_system, publish, text_slices

MAGIC = b"\x1f\x8b\x08"
DATE = "2020-01-01T00:00:00Z"
RANGE_BYTES = 4 << 20
#: Repeated payloads, at most, that are sent to all rows; beyond, rows are shuffled to them.
BROADCAST_ROWS = 1 << 17
BLOCK = 1 << 20
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}/{digest}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, level: int = 6) -> bytes:
    """One gzip member: a response, or a revisit of page `first` that has the payload's headers alone."""
    digest = _digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if page_id is not None:
        head.append(f"WARC-Page-Id: {page_id}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(first, digest)}", f"WARC-Refers-To-Page: {first}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + deflate.flush()


def write_archives(pages: DataFrame, path: str, level: int = 6) -> DataFrame:
    """Archive `pages` (page_id, url, html; other columns are ignored). Returns the written manifest: path, bytes, records.

    Of the pages with equal payloads that with the smallest page_id is a response and the others revisit
    it. A null html is an empty payload; a null page_id is never the first; rows that repeat the first's page_id are
    responses too; a null url is left out; an empty table gives no file.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("payload", F.sha1("html"))
    # only payloads that occur again need a partner
    firsts = rows.groupBy("payload").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload", "first")
    firsts = materialize(firsts, "payloads")
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    joined = rows.join(firsts, "payload", "left").select("page_id", "url", "html", F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = f"{path}/pages-{TaskContext.get().partitionId():06d}.warc.gz"
        records = 0

        def write(out) -> None:
            nonlocal records
            for part in text_slices(batches, "html"):
                for row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                    out.write(encode_record(row[0], row[1], row[2].encode(), row[3], level))
                    records += 1

        size = publish(file, write)
        if records:
            yield pa.RecordBatch.from_pylist([{"path": file, "bytes": size, "records": records}])

    return materialize(joined.mapInArrow(run, "path string, bytes long, records long"), "archives")


class _Window:
    """Bytes of a file from any offset, a block at a time."""

    def __init__(self, uri: str) -> None:
        fs, path = file_system(uri)
        self.file, self.base, self.data = fs.open_input_file(path), 0, b""
        self.size = self.file.size()

    def need(self, start: int, end: int) -> None:
        """Hold what there is of [start, end), and nothing before start."""
        end = min(end, self.size)
        if start < self.base or start > self.base + len(self.data):
            self.base, self.data = start, b""
        elif start > self.base:
            self.data, self.base = self.data[start - self.base :], start
        have = self.base + len(self.data)
        if have < end:
            self.file.seek(have)
            self.data += self.file.read(max(end - have, BLOCK))

    def find(self, start: int, end: int) -> int:
        """The first magic that begins in [start, end), or -1."""
        while start < end:
            stop = min(start + BLOCK, end)
            self.need(start, stop + 2)
            at = self.data.find(MAGIC, 0, stop + 2 - self.base)
            if at >= 0:
                return self.base + at
            start = stop
        return -1


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The content and the end of the record that begins at `at`, or None if no whole one does."""
    inflate = zlib.decompressobj(31)
    out, pos = [], at
    try:
        while not inflate.eof:
            window.need(pos, pos + 4096 if pos == at else pos + BLOCK)
            piece = window.data[: 4096 if pos == at else BLOCK]
            if not piece:
                return None
            out.append(inflate.decompress(piece))
            if pos == at and not out[0].startswith(b"WARC/1."):
                return None
            pos += len(piece)
    except zlib.error:
        return None
    return b"".join(out), pos - len(inflate.unused_data)


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse_record(content: bytes) -> dict | None:
    """Named header fields (lower-case) and the block of a record, or None if they don't hold together."""
    head, sep, rest = content.partition(b"\r\n\r\n")
    fields = {k.decode("latin-1").strip().lower(): v.decode("utf-8", "replace") for k, v in _HEADER.findall(head + b"\r\n")}
    length = fields.get("content-length", "")
    if not sep or not length.isdigit() or len(rest) < int(length):
        return None
    return fields | {"block": rest[: int(length)]}


def read_range(uri: str, start: int, end: int) -> Iterator[dict]:
    """The records of a file that begin in [start, end), with the places where they begin and end.

    Where a payload is an archive itself and lies uncompressed in its record, a range that begins inside that record finds the inner ones too.
    """
    window, at = _Window(uri), start
    while 0 <= (at := window.find(at, end)):
        got = _member(window, at)
        record = got and parse_record(got[0])
        if record:
            yield record | {"at": at, "end": got[1]}
        at = got[1] if record else at + 1


def _unchunked(body: bytes) -> bytes:
    """The content of a body in chunks; what there is of one that ends early."""
    out, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n").match(body, at):
        size = int(m[1], 16)
        if not size:
            break
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size + 2
    return b"".join(out)


def record_row(x: dict) -> dict:
    """What read_archives() returns of a parsed record, and as fault what its headers say otherwise."""
    kind, digest = x.get("warc-type", "").lower(), x.get("warc-payload-digest", "").removeprefix("sha1:")
    payload, size, fault = x["block"], None, None
    if "application/http" in x.get("content-type", "").lower():
        http, _, payload = x["block"].partition(b"\r\n\r\n")
        if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked", http):
            payload = _unchunked(payload)
        named = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
        size = int(named[1]) if named else None
    if kind == "revisit":
        payload = None
    else:
        if size not in (None, len(payload)) or digest not in ("", _digest(payload)) and len(digest) == 32:
            fault = f"the payload of {x.get('warc-record-id')} isn't what its headers say"
        size, digest = len(payload), _digest(payload)
    number = lambda name: int(v) if re.fullmatch(r"-?\d{1,18}", v := x.get(name, "")) else None
    return {"page_id": number("warc-page-id"), "payload_bytes": size, "payload_digest": digest or None, "record_type": kind or None, "refers_to": number("warc-refers-to-page"), "url": x.get("warc-target-uri"), "fault": fault, "at": x["at"], "end": x["end"], "payload": payload}


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = False, strict: bool = True) -> DataFrame:
    """One row per record of the files of a manifest (path, bytes): page_id, payload_bytes, payload_digest, record_type, refers_to, url, and the payload on request (null for revisits).

    The payload of an HTTP message is its body without chunks, as it was encoded; that of any other record (warcinfo, metadata, ...) is its block. Size and digest of a
    revisit are those its headers name, or null. page_id and refers_to are null in records that others wrote. A payload that isn't what
    its headers say raises ValueError if `strict`, else it is described as it is. What is no record is passed over. The result doesn't depend on the ranges: records that
    begin before the end of one that an earlier range of the file owns lie in its payload, and go.
    """
    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(range_bytes))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "bytes").alias("stop"))
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())] + [("payload", pa.binary())] * with_payload
    arrow = pa.schema([*fields, ("fault", pa.string()), ("at", pa.int64()), ("end", pa.int64()), ("path", pa.string()), ("start", pa.int64())])
    schema = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else f.type}" for f in arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                for x in read_range(r["path"], r["start"], r["stop"]):
                    rows.append({k: v for k, v in (record_row(x) | {"path": r["path"], "start": r["start"]}).items() if k in arrow.names})
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    found = materialize(ranges.repartition(task_partitions(manifest)).mapInArrow(run, schema), "records")
    # one row a range, of which a file has few
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = materialize(found.groupBy("path", "start").agg(F.max("end").alias("end")).select("path", "start", F.coalesce(F.max("end").over(earlier), F.lit(0)).alias("taken")), "ends")
    if ends.count() <= BROADCAST_ROWS:
        ends = F.broadcast(ends)
    own = found.join(ends, ["path", "start"]).where("at >= taken")
    if strict:
        own = own.where(F.when(F.col("fault").isNull(), True).otherwise(F.raise_error(F.col("fault")).cast("boolean")))
    return own.select(*(name for name, _ in fields))


def archived_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    return read_archives(write_archives(pages, new_path(spark, "warc"))).drop("url")
