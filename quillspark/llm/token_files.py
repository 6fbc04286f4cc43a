"""Token-id files with a shared zstandard dictionary.

A file holds one zstandard frame per document, compressed with a dictionary trained on
serialised id arrays, then an index (doc_id, number of ids, offset), and a footer that names the dictionary by
its hash, so any document can be read by itself. Layout, little-endian:

    "QTOK0001" | frames | index rows (int64 doc_id, uint8 null, uint64 n_ids, uint64 offset) | footer JSON | uint32 footer size | "QTOK0001"

Ids are unsigned 16-bit where the vocabulary allows it, else 32-bit.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import delete, materialize, new_path, task_partitions
from .batches import file_system, publish, text_bytes, text_slices
from .chunked import library_encoder

MAGIC = b"QTOK0001"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n_ids", "<u8"), ("offset", "<u8")])
SAMPLE_DOCS = 1024  # the dictionary is trained on about so many documents
SAMPLE_IDS = 8_192  # and at most so many first ids of each
DICTIONARY_BYTES = 64 << 10
FILE_BYTES = 64 << 20


def _width(tokenizer: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from a sample of about SAMPLE_DOCS documents by the hash of their ids; empty for too small a corpus."""
    n, width = docs.count(), _width(tokenizer)
    chance = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(max(1, n // SAMPLE_DOCS)))
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "text").where(chance == 0).limit(2 * SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer, "space")
        for part in text_slices(batches):
            ids, counts = encoder(part.column("text").to_pylist(), *text_bytes(part.column("text")))
            ends = np.cumsum(counts)
            own = [np.append(ids[a : min(b, a + SAMPLE_IDS)], end_id).astype(width).tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], names=["ids"])

    arrays = [bytes(r.ids) for r in sample.mapInArrow(run, "ids binary").toLocalIterator()]
    arrays.sort()
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, arrays)) // 8), arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _frames(docs: DataFrame, tokenizer: str, end_id: int, dictionary: bytes, level: int) -> DataFrame:
    width = _width(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer, "space")
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level)
        compress = zstandard.ZstdCompressor(level=0 if shared else level, dict_data=shared, write_dict_id=False).compress
        for part in text_slices(batches):
            column = part.column("text")
            ids, counts = encoder(["" if x is None else x for x in column.to_pylist()], *text_bytes(column))
            ends = np.cumsum(counts)
            frames = [compress(np.append(ids[a:b], end_id).astype(width).tobytes()) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts + 1, pa.int64()), pa.array([len(x) for x in frames], pa.int64()), pa.array(frames, pa.binary())], names=["doc_id", "n_ids", "frame_bytes", "frame"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, frame_bytes long, frame binary")


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, level: int = 3) -> DataFrame:
    """Encode `docs` (doc_id, text; other columns are ignored) and write files in ascending doc_id order, nulls first.

    Returns the written manifest: file_no, path, n_docs, n_ids, file_bytes; files follow one another in
    the order of file_no. Null and empty texts are the end id alone; repeated rows are all
    written, in any order among themselves where they are equal; an empty table gives no file.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, end_id)
    name, width = hashlib.sha256(dictionary).hexdigest(), _width(tokenizer)
    publish(f"{path}/{name}.dict", lambda out: out.write(dictionary))
    stage = new_path(spark, "frames")
    frames = materialize(_frames(docs, tokenizer, end_id, dictionary, level), "frames", stage)
    total = frames.agg(F.sum("frame_bytes")).first()[0] or 0
    files = max(-(-total // FILE_BYTES), min(task_partitions(docs), -(-total // (1 << 20))), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        index: list[tuple] = []

        def write(out) -> None:
            out.write(MAGIC)
            at = len(MAGIC)
            for batch in batches:
                for doc_id, n, frame in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_ids", "frame")), strict=True):
                    index.append((doc_id or 0, doc_id is None, n, at))
                    out.write(frame)
                    at += len(frame)
            out.write(np.array(index, INDEX).tobytes())
            footer = json.dumps({"dictionary": name, "ids": width, "docs": len(index), "index": at}).encode()
            out.write(footer + struct.pack("<I", len(footer)) + MAGIC)

        file = f"{path}/part-{number:06d}.qtok"
        size = publish(file, write)
        if index:
            yield pa.RecordBatch.from_pylist([{"file_no": number, "path": file, "n_docs": len(index), "n_ids": sum(x[2] for x in index), "file_bytes": size}])

    ordered = frames.repartitionByRange(files, "doc_id", "n_ids", "frame_bytes").sortWithinPartitions("doc_id", "n_ids", "frame_bytes")
    manifest = materialize(ordered.select("doc_id", "n_ids", "frame").mapInArrow(run, "file_no long, path string, n_docs long, n_ids long, file_bytes long"), "manifest")
    delete(spark, stage)
    return manifest


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, uri: str) -> None:
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self._at(size - 12, 12)
        if tail[4:] != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError(f"{uri} isn't a whole token file")
        (n,) = struct.unpack("<I", tail[:4])
        self.footer = json.loads(self._at(size - 12 - n, n))
        self.width, self.end = np.dtype(self.footer["ids"]), self.footer["index"]
        self.index = np.frombuffer(self._at(self.end, self.footer["docs"] * INDEX.itemsize), INDEX)
        with fs.open_input_file(f"{path.rsplit('/', 1)[0]}/{self.footer['dictionary']}.dict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).hexdigest() != self.footer["dictionary"]:
            raise ValueError("the dictionary isn't the one that the file names")
        self.decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document, read by itself."""
        start = int(self.index["offset"][i])
        end = int(self.index["offset"][i + 1]) if i + 1 < len(self.index) else self.end
        return np.frombuffer(self.decompress(self._at(start, end - start)), self.width)


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids in all earlier documents), n_tokens, ids_crc32, and the ids on request, of the files of a manifest.

    Only the manifest, one row per file, meets in one task, to sum what lies before each file.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                file = TokenFile(path)
                n = file.index["n_ids"].astype(np.int64)
                start = at + np.cumsum(n) - n
                for a in range(0, len(n), 1024):
                    some = range(a, min(a + 1024, len(n)))
                    ids = [file.ids(i) for i in some]
                    if [len(x) for x in ids] != n[some].tolist():
                        raise ValueError(f"{path}: a document's ids aren't as many as its index says")
                    part = file.index[a : a + 1024]
                    columns = [pa.array(part["doc_id"].astype(np.int64), mask=part["null"].astype(bool)), pa.array(start[some]), pa.array(n[some]), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("before", before).select("path", "before")
    return placed.repartition(task_partitions(manifest)).mapInArrow(run, schema)


def token_file_rows(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    return read_token_files(write_token_files(docs, tokenizer, new_path(spark, "tokens"), end_id))
