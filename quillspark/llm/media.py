"""Images in binary columns: payloads as 8-bit greyscale PNG, checked, unfiltered and hashed.

A payload becomes rows of 64 samples. The writer makes the chunks itself (IHDR, IDAT, IEND with
their checksums, the samples through zlib); the reader tests every checksum, inflates, undoes
the row filters with numpy and computes a perceptual hash from the low-frequency cosine
coefficients of the image scaled to 32 x 32.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.shared import materialize
from .batches import text_slices

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
_SIDE = 32
_COSINE = np.cos(np.pi * (2 * np.arange(_SIDE)[None, :] + 1) * np.arange(9)[:, None] / (2 * _SIDE))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(payload: bytes, width: int = WIDTH, level: int = 3) -> bytes:
    """An 8-bit greyscale PNG of rows of `width` bytes. Each row is stored as it is or as differences from the row above, whichever repeats more zeros."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    up = rows.copy()
    up[1:] -= rows[:-1]
    kind = np.where(2 * (up == 0).sum(1) > width, 2, 0).astype(np.uint8)
    out = np.empty((len(rows), width + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = np.where((kind == 2)[:, None], up, rows)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG without interlace; ValueError if anything is wrong with it."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, body, closed = 8, None, [], False
    while at < len(data) and not closed:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        (size,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(part) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + part)):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        closed = kind == b"IEND"
        at += 12 + size
    if head is None or not closed or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit greyscale image")
    width, height = head[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(raw) != height * (width + 1):
        raise ValueError("the samples don't fill the image")
    return unfilter(raw.reshape(height, width + 1))


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Undo the row filters: runs of rows without one or with differences from above go at once, the others row by row."""
    kind, out = rows[:, 0], rows[:, 1:].copy()
    if kind.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    cuts = np.flatnonzero(np.diff(kind)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
        k = int(kind[a]) if b > a else 0
        above = out[a - 1] if a else np.zeros(out.shape[1], np.uint8)
        if k == 1:
            out[a:b] = np.cumsum(out[a:b], axis=1, dtype=np.uint8)
        elif k == 2:
            out[a] += above
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif k in (3, 4):
            for y in range(a, b):
                out[y] = _unfilter_row(k, out[y].tolist(), (out[y - 1] if y else above).tolist())
    return out


def _unfilter_row(kind: int, row: list[int], above: list[int]) -> list[int]:
    left = corner = 0
    for x, up in enumerate(above):
        if kind == 3:
            guess = (left + up) >> 1
        else:
            p = left + up - corner
            guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
        left = row[x] = (row[x] + guess) & 255
        corner = up
    return row


def _shrink(image: np.ndarray) -> np.ndarray:
    """Block means on a 32 x 32 grid; rows are repeated where there are fewer."""
    h, w = image.shape
    if h < _SIDE:
        image = image[np.arange(_SIDE) * h // _SIDE]
        h = _SIDE
    edge = np.arange(_SIDE) * h // _SIDE
    tall = np.add.reduceat(image, edge, axis=0, dtype=np.float64) / np.diff(edge, append=h)[:, None]
    edge = np.arange(_SIDE) * w // _SIDE
    return np.add.reduceat(tall, edge, axis=1) / np.diff(edge, append=w)


def cosine_hash(image: np.ndarray) -> str:
    """64 bits in hex: the 8 x 8 lowest cosine coefficients without the constant row and column, each against their median."""
    low = (_COSINE @ _shrink(image) @ _COSINE.T)[1:9, 1:9].round(6)
    return np.packbits(low > np.median(low)).tobytes().hex()


def store_media(docs: DataFrame, level: int = 3) -> DataFrame:
    """doc_id, n_bytes, media (binary): each text of `docs` in UTF-8, padded with bytes 0 to a positive multiple of 64, as PNG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            raw = [(x or "").encode() for x in part.column("text").to_pylist()]
            media = [write_png(x + bytes(-len(x) % WIDTH if x else WIDTH), level=level) for x in raw]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read the images back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error.

    A broken image doesn't stop the job: `error` says what is wrong and the columns read from it are null.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "media"):
            rows = []
            for data in part.column("media").to_pylist():
                try:
                    image = read_png(data or b"")
                    payload = image.tobytes()
                    got = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), cosine_hash(image), None)
                except (ValueError, zlib.error, struct.error) as e:
                    got = (None, None, None, None, str(e))
                rows.append((*got[:3], len(data or b""), hashlib.sha256(data or b"").hexdigest(), *got[3:]))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Store the texts of `docs` (doc_id, text; other columns are ignored) as PNG in a written table, read it back and compute features.

    Null and empty texts are one row of zeros; repeated rows give repeated results; an empty table gives no rows.
    """
    return media_features(materialize(store_media(docs), "media")).drop("error")
