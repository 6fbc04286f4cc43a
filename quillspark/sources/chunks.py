"""Large text files by byte ranges: a splittable source, and matches that each range owns once.

A row ends where Spark's rows end, and a file that is one long line can't be split by lines. Here a task reads a range of bytes, moved to
where characters begin, and some text to either side, so a match that crosses a cut is seen whole; it belongs to the range in
which it begins. Which codec a file has is only known once all its ranges were read, so a range comes in both.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.spans import spans
from ..plans.shared import materialize

CHUNK_BYTES, OVERLAP_BYTES = 1 << 23, 1 << 14
#: Bytes of ranges that a task reads, one after the other: a task for each small range would be all start and no work.
TASK_BYTES = 1 << 23
#: Files whose codecs go to all tasks whole.
BROADCAST_FILES = 1 << 16
_TEXT = "struct<text: string, first: int, last: int>"
_SCHEMA = f"path string, start long, stop long, utf8_valid boolean, utf8 {_TEXT}, korean {_TEXT}"
_ARROW = pa.struct([("text", pa.string()), ("first", pa.int32()), ("last", pa.int32())])


def _open(path: str):
    """(file system, path) of a URI or a plain path."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Bytes:
    """A file's bytes from any place on."""

    def __init__(self, path: str) -> None:
        fs, own = _open(path)
        self.file = fs.open_input_file(own)
        self.size = self.file.size()

    def between(self, start: int, stop: int) -> bytes:
        start, stop = max(start, 0), min(stop, self.size)
        if start >= stop:
            return b""
        self.file.seek(start)
        return self.file.read(stop - start)


def _utf8_begin(data: _Bytes, at: int) -> int:
    """The first place from `at` on where a character of UTF-8 begins; three bytes at most go on with one."""
    if at <= 0 or at >= data.size:
        return min(max(at, 0), data.size)
    for i, b in enumerate(data.between(at, at + 4)):
        if b & 0xC0 != 0x80:
            return at + i
    return min(at + 4, data.size)


def _single(b: int) -> bool:
    """Whether a byte of the Korean code page is a character by itself, wherever it stands: it is no second byte."""
    return b < 0x41 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x80


def _korean_begin(data: _Bytes, at: int, step: int = 1 << 12) -> int:
    """The first place from `at` on where a character of the Korean code page begins, counted from the last byte before that stands alone for certain."""
    if at <= 0 or at >= data.size:
        return min(max(at, 0), data.size)
    low, block = at, b""
    while low > 0:
        low = max(0, low - step)
        block = data.between(low, at)
        found = next((i for i in range(len(block) - 1, -1, -1) if _single(block[i])), None)
        if found is not None:
            low, block = low + found + 1, block[found + 1 :]
            break
        step *= 2
    pos = 0
    while pos < len(block):
        pos += 2 if block[pos] >= 0x81 else 1
    return min(low + pos, data.size)


def _decoded(data: _Bytes, start: int, stop: int, overlap: int, codec: str, begin, lossy: bool) -> tuple[dict | None, bool]:
    """The text of a range with text to either side, which characters are its own, and whether its bytes are valid; no text of invalid bytes, unless it may be lossy."""
    first, last = begin(data, start), begin(data, stop)
    own, valid = data.between(first, last), True
    try:
        text = own.decode(codec)
    except UnicodeDecodeError:
        if not lossy:
            return None, False
        text, valid = own.decode(codec, "ignore"), False
    before = data.between(begin(data, first - overlap), first).decode(codec, "ignore")
    after = data.between(last, begin(data, last + overlap)).decode(codec, "ignore")
    return {"text": before + text + after, "first": len(before), "last": len(before) + len(text)}, valid


class _Ranges(InputPartition):
    """Ranges (path, start, stop) of one task."""

    def __init__(self, ranges: list[tuple[str, int, int]]) -> None:
        super().__init__(ranges)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options.get("path", "")
        self.chunk, self.overlap = int(options.get("chunkbytes", CHUNK_BYTES)), int(options.get("overlapbytes", OVERLAP_BYTES))
        if self.chunk < 1:
            raise ValueError("chunkBytes must be positive")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pafs

        fs, own = _open(self.path)
        info = fs.get_file_info(own)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(own, recursive=True))
        root = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.size and not any(p[:1] in "._" for p in f.path[len(own) :].split("/") if p))
        # files' ends don't end a task, so many small files are few tasks too; a span is a whole number of ranges
        span = self.chunk * max(1, TASK_BYTES // self.chunk)
        spans = [(root + path if root else path, a, min(a + span, size)) for path, size in files for a in range(0, size, span)]
        parts, held = [[]], 0
        for part in spans:
            if held + part[2] - part[1] > span:
                parts.append([])
                held = 0
            parts[-1].append(part)
            held += part[2] - part[1]
        return [_Ranges(p) for p in parts if p]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:
            return
        for path, first, last in partition.value:
            data = _Bytes(path)
            for start in range(first, last, self.chunk):
                yield self.row(path, data, start, min(start + self.chunk, last))

    def row(self, path: str, data: _Bytes, start: int, stop: int) -> pa.RecordBatch:
        utf8, valid = _decoded(data, start, stop, self.overlap, "utf-8", _utf8_begin, True)
        korean, _ = _decoded(data, start, stop, self.overlap, "cp949", _korean_begin, False)
        columns = [pa.array([path]), pa.array([start], pa.int64()), pa.array([stop], pa.int64()), pa.array([valid]), pa.array([utf8], _ARROW), pa.array([korean], _ARROW)]
        return pa.RecordBatch.from_arrays(columns, names=["path", "start", "stop", "utf8_valid", "utf8", "korean"])


class TextChunks(DataSource):
    """spark.read.format("text_chunks").load(file or folder), with chunkBytes and overlapBytes: a row a byte range. Hidden files are left out."""

    @classmethod
    def name(cls) -> str:
        return "text_chunks"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def chunked_texts(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES) -> DataFrame:
    """path, start, stop, codec, text, first, last of the ranges of the files at a path: the text, of which the characters from first to last (excluded) are the range's own.

    A file is UTF-8 if all its ranges are, else the Korean code page if all are, else UTF-8 without what is invalid (codec utf-8-lossy).
    """
    spark.dataSource.register(TextChunks)
    rows = spark.read.format("text_chunks").option("chunkBytes", chunk_bytes).option("overlapBytes", overlap_bytes).load(path)
    codec = F.when(F.bool_and("utf8_valid"), "utf-8").when(F.bool_and(F.col("korean").isNotNull()), "cp949").otherwise("utf-8-lossy")
    known = materialize(rows.groupBy("path").agg(codec.alias("codec")), "codecs")
    # the codecs of so few files go to the texts, which then aren't shuffled
    if known.count() <= BROADCAST_FILES:
        known = F.broadcast(known)
    own = F.when(F.col("codec") == "cp949", F.col("korean")).otherwise(F.col("utf8"))
    return rows.join(known, "path").select("path", "start", "stop", "codec", own.alias("own")).select("path", "start", "stop", "codec", "own.*")


def chunk_matches(chunks: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """path, start (of the range), kind, found: every match of the patterns that begins in a range's own text, so each match of a file once.

    A match, with what a pattern looks at around it, must fit the overlap.
    """
    found = spans(chunks.select("path", F.col("start").alias("range"), "first", "last", "text"), patterns)
    return found.where((F.col("start") >= F.col("first")) & (F.col("start") < F.col("last"))).select("path", F.col("range").alias("start"), "kind", "found")
