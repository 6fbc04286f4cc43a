"""Arrow batches in tasks: bounded slices, raw text bytes, ragged gathers, and files by URI."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that a task works on at once; longer texts come alone.
SLICE_BYTES = 1 << 20


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batches with at most `budget` bytes of text each, or one row.

    A worker goes on to other tasks and stages, so what earlier ones have freed goes back to the system first.
    """
    pa.default_memory_pool().release_unused()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
        group = (np.cumsum(size) - size) // budget
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, null as empty, and the offset of each text."""
    array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0]+1, ... of all runs, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def file_system(uri: str):
    """(file system, path) of a URI or a plain path."""
    from pyarrow import fs

    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def publish(uri: str, write) -> int:
    """Write a file under a private name and rename it, so that retries and twins of a task leave one whole file. Returns its size."""
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    private = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(private) as out:
        write(out)
        size = out.tell()
    fs.move(private, path)
    return size


def fresh_name(df, name: str) -> str:
    """`name`, with underscores in front until no column of `df` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
