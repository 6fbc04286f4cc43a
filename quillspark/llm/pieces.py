"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's symbols are its characters; an agenda holds the adjacent pairs whose join is a piece,
best score first and leftmost on ties, and merges run until it is empty. No piece of such a
vocabulary holds a space after another character, so a run of spaces begins an independent
chunk, and each distinct chunk is encoded once and cached. In every Arrow batch the new chunks,
and one whole text, are checked against the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import text_bytes, text_slices
from .chunked import ChunkEncoder

_MARK = "▁"


class PieceModel:
    """The pieces of a merge-type model file, with the library's own processor beside them."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank, self.byte, scores = {}, {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                scores[piece] = (-sp.get_score(i), i)
        self.rank = scores
        if any(_MARK in x.lstrip(_MARK) for x in scores):
            raise ValueError("a piece holds a space inside: its chunks aren't independent")
        if sp.encode("  a") == sp.encode("a"):
            raise ValueError("this vocabulary folds spaces, which isn't supported")

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk in which spaces are written as the mark."""
        rank = self.rank
        symbol = list(chunk)
        n = len(symbol)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for i in range(n - 1):
            if (found := rank.get(symbol[i] + symbol[i + 1])) is not None:
                agenda.append((found[0], i, symbol[i] + symbol[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, i, joined = heapq.heappop(agenda)
            j = right[i]
            if symbol[i] is None or j < 0 or len(symbol[i]) + len(symbol[j]) != len(joined) or symbol[i] + symbol[j] != joined:
                continue  # one side has since merged with another
            symbol[i], symbol[j] = joined, None
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (found := rank.get(joined + symbol[k])) is not None:
                    heapq.heappush(agenda, (found[0], i, joined + symbol[k]))
            if (h := left[i]) >= 0 and (found := rank.get(symbol[h] + joined)) is not None:
                heapq.heappush(agenda, (found[0], h, symbol[h] + joined))
        ids = []
        for x in symbol:
            if x is None:
                continue
            if (found := rank.get(x)) is not None:
                ids.append(found[1])
            else:
                ids += [self.byte[b] for b in x.encode()]
        return ids

    def encoder(self) -> ChunkEncoder:
        """Chunks by the agenda, each new one compared with the library; texts with a literal mark or NUL go to the library whole."""

        def whole(texts: list[str]) -> list[list[int]]:
            return self.library.encode(texts, num_threads=1)

        def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            texts = [x.decode() for x in chunks]
            got = [self.merge(x.replace(" ", _MARK)) for x in texts]
            # the library puts a space in front of its own, but not before nothing
            plain = [x[1:] if x[:1] == " " else x for x in texts]
            for x, ours, theirs in zip(texts, got, self.library.encode(plain, num_threads=1), strict=True):
                if x == " ":
                    theirs = self.library.encode("a ")[len(self.library.encode("a")) :]
                if ours != theirs:
                    raise ValueError(f"the agenda and the library differ on {x!r}: {ours} and {theirs}")
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter((y for x in got for y in x), np.uint32, int(sizes.sum())), sizes

        return ChunkEncoder(encode, whole, "piece", re.compile("[\\x00▁]"))


def encode_pieces(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """Encode the texts of `docs` (doc_id, text; other columns are ignored) and decode them again.

    Returns doc_id, n_tokens, ids_sha256 (of the ids with begin and end, little-endian unsigned
    32-bit), decoded_sha256, and ids and decoded text on request. Null and empty texts are the begin and
    end ids alone and decode to the empty text; repeated rows give repeated results; an empty
    table gives no rows.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel(model)
        encoder, sp = pieces.encoder(), pieces.library
        begin, end = sp.bos_id(), sp.eos_id()
        for part in text_slices(batches):
            column = part.column("text")
            texts = ["" if x is None else x for x in column.to_pylist()]
            ids, counts = encoder(texts, *text_bytes(column))
            ends = np.cumsum(counts)
            if texts and sp.encode(texts[0]) != ids[: counts[0]].tolist():
                raise ValueError("chunks and the library differ on a whole text")
            out = {"n": [], "ids": [], "sha": [], "back": []}
            for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                own = ids[a:b]
                all_ids = np.concatenate(([begin], own, [end])).astype("<u4")
                listed = all_ids.tolist()
                back = sp.decode(listed)
                out["n"].append(b - a + 2)
                out["sha"].append(hashlib.sha256(all_ids.tobytes()).hexdigest())
                out["back"].append(back)
                if with_ids:
                    out["ids"].append(listed)
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in out["back"]]
            columns = [part.column("doc_id"), pa.array(out["n"], pa.int64()), pa.array(out["sha"]), pa.array(digest)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["back"])]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
