"""Sequence packing: first-fit decreasing in randomised groups of documents.

Texts become ids; a document longer than a sequence is cut into whole sequences and a rest.
Rests are dealt at random into groups of bounded size, and each group is packed by itself with
a tournament tree over the free room of its bins, so work and memory of a task don't grow with
the corpus and no rows of a key need to meet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize, task_partitions
from .batches import ragged, text_bytes, text_slices
from .chunked import library_encoder

LENGTH = 2048
GROUP_DOCS = 8192


class Tournament:
    """First fit: each inner node knows the most free room below it, so the leftmost bin with room is found in log2(bins) steps."""

    def __init__(self, bins: int, room: int) -> None:
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.most = [room] * (2 * self.size)

    def place(self, need: int) -> tuple[int, int]:
        """(bin, room it had) of the first bin with `need` free; the room is taken."""
        most, i = self.most, 1
        while i < self.size:
            i = 2 * i if most[2 * i] >= need else 2 * i + 1
        bin_, had = i - self.size, most[i]
        most[i] = had - need
        while i > 1:
            i >>= 1
            best = max(most[2 * i], most[2 * i + 1])
            if most[i] == best:
                break
            most[i] = best
        return bin_, had


def first_fit_decreasing(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each size, and the number of bins. Ties keep their order."""
    bins, offsets, used = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    if len(sizes):
        tree = Tournament(len(sizes), length)
        for i in np.argsort(-sizes, kind="stable").tolist():
            b, had = tree.place(int(sizes[i]))
            bins[i], offsets[i] = b, length - had
            used = max(used, b + 1)
    return bins, offsets, used


def token_rows(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, with_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, `keep`, doc_tokens, the crc32 of each cut of `length` ids, and the ids themselves on request."""
    fields = [docs.schema[c] for c in ("doc_id", *keep)]
    schema = "doc_id long, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields[1:]) + "doc_tokens long, crcs array<long>" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer, "word")
        for part in text_slices(batches):
            texts = part.column("text")
            ids, counts = encoder(["" if x is None else x for x in texts.to_pylist()], *text_bytes(texts))
            ends = np.cumsum(counts)
            crcs, raw = [], []
            for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                own = np.append(ids[a:b], end_id).astype("<u4")
                crcs.append([zlib.crc32(own[i : i + length]) for i in range(0, len(own), length)])
                if with_ids:
                    raw.append(own.tobytes())
            columns = [part.column(c) for c in ("doc_id", *keep)] + [pa.array(counts + 1, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, names=["doc_id", *keep, "doc_tokens", "crcs", *["ids"] * with_ids])

    return docs.select("doc_id", *keep, "text").mapInArrow(run, schema)


def pack(rows: DataFrame, length: int = LENGTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `rows` are token_rows() from a written table: they are dealt round robin in the order of
    their hashes, which is random to the packing but the same when a task runs again.
    Sequence ids are unique, not consecutive: the partition's number in the upper 32 bits.
    """

    def emit(ids: list, tokens: list, crcs: list, base: int) -> tuple[pa.RecordBatch, int]:
        n = np.array(tokens, np.int64)
        cuts = -(-n // length)
        owner = np.repeat(np.arange(len(n)), cuts)
        start = ragged(np.zeros(len(n), np.int64), cuts) * length
        size = np.minimum(length, n[owner] - start)
        sequence, offset = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        full = size == length
        bins, offset[~full], used = first_fit_decreasing(size[~full], length)
        sequence[~full] = base + bins
        sequence[full] = base + used + np.arange(full.sum())
        columns = [pa.array(ids, pa.int64()).take(pa.array(owner)), pa.array(start), pa.array(size), pa.array([c for x in crcs for c in x], pa.int64()), pa.array(n[owner]), pa.array(sequence), pa.array(offset)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]), base + used + int(full.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        ids, tokens, crcs = [], [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            tokens += batch.column("doc_tokens").to_pylist()
            crcs += batch.column("crcs").to_pylist()
            while len(ids) >= group_docs:
                out, base = emit(ids[:group_docs], tokens[:group_docs], crcs[:group_docs], base)
                yield out
                ids, tokens, crcs = ids[group_docs:], tokens[group_docs:], crcs[group_docs:]
        if ids:
            yield emit(ids, tokens, crcs, base)[0]

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.select("doc_id", "doc_tokens", "crcs").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pack the texts of `docs` (doc_id, text; other columns are ignored) into sequences of at most `length` ids.

    Null and empty texts are documents of the end id alone; repeated rows are packed each by
    itself; a null doc_id is kept as null; an empty table gives no rows. Ids are those of the
    tokenizers library for the whole text, then `end_id`.
    """
    rows = materialize(token_rows(docs, tokenizer, end_id, length), "pack")
    n = rows.count()
    groups = max(1, min(task_partitions(docs), -(-n // group_docs)))  # whole groups, in as many tasks as there are
    return pack(rows.repartition(groups), length, group_docs)


def packed_sequences(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """The training sequences: sequence_id, ids (little-endian unsigned 32-bit) padded to `length` unless their number is a power of two."""
    rows = materialize(token_rows(docs.withColumn("__row", F.monotonically_increasing_id()).select(F.col("__row").alias("doc_id"), "text"), tokenizer, end_id, length, with_ids=True), "pack-ids")
    places = pack(rows.repartition(max(1, min(task_partitions(docs), -(-rows.count() // GROUP_DOCS)))), length)
    parts = places.join(rows.select("doc_id", "ids"), "doc_id").select("sequence_id", F.struct("offset", F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))").alias("ids")).alias("part"), "length")
    whole = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum("length").alias("n_ids"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    pad = F.expr(f"cast(repeat(cast(X'{pad_id.to_bytes(4, 'little').hex()}' as string), cast({length} - n_ids as int)) as binary)")
    return whole.select("sequence_id", "n_ids", F.when(F.bit_count("n_ids") == 1, joined).otherwise(F.concat(joined, pad)).alias("ids"))
