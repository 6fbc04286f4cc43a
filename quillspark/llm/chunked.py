"""Encode texts through a cache of their distinct chunks.

A subword vocabulary never merges across certain places of a text, so the ids of a text are
those of its chunks in a row. The chunks of a slice are found and told apart by numpy on the
bytes; only chunks not met before are encoded, in one call. A cache holds the first chunks met,
up to a limit; those beyond it are encoded again in each slice where they occur, so memory is
bounded and results don't depend on it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .batches import ragged

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd: it has an inverse modulo 2**64
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_POINT = np.zeros(256, bool)  # ASCII punctuation without the apostrophe, which may begin a contraction
_POINT[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: White space that the byte masks don't know: texts that hold any of it go to the encoder whole.
_RARE_SPACE = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    have, factor = 1, base
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(factor)
        have += take
        factor = factor * factor & _MASK
    return out


class _Hash:
    """64-bit hashes of byte ranges from prefix sums."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def ranges(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.up) < len(data) + 1:
            n = max(1 << 16, 2 * len(data) + 1)
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=total[1:])
        h = (total[end] - total[start]) * self.down[start]
        h ^= h >> np.uint64(29)
        return h * np.uint64(0xBF58476D1CE4E5B9) + (end - start).astype(np.uint64)


class ChunkEncoder:
    """Ids of texts by way of their chunks.

    encode: ids of each of a list of chunks, as one array and their counts. whole: ids of each of a list of whole texts, used for
    texts that `rare` finds something in. cut: "space" (a chunk begins at white space and holds
    the one space before a word), "word" (white space is dropped and case doesn't count) or "piece" (a chunk begins at a
    run of spaces and each text gets a space in front). slots: places of the cache, a power of
    two; a chunk has one place, by its 64-bit hash, and is known if the hash there is its own.
    """

    def __init__(self, encode: Callable, whole: Callable, cut: str, rare: re.Pattern = _RARE_SPACE, slots: int = 1 << 21) -> None:
        self.encode, self.whole, self.cut, self.rare = encode, whole, cut, rare
        self.hash = _Hash()
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0
        self.key, self.start, self.length = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), np.zeros(slots, np.int32)

    def _bounds(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the chunks."""
        n = len(data)
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        if self.cut == "piece":
            space = data == 32
            begins = space.copy()
            begins[1:] &= ~space[:-1]
            begins[first] = True
            start = np.flatnonzero(begins)
            return start, np.append(start[1:], n)
        space = _SPACE[data]
        # between a letter or digit and punctuation there is always a cut
        word = _ALNUM[data]
        word[1:] |= (data[1:] >= 128) & (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        point = np.zeros(n + 1, bool)
        point[1:n] = _POINT[data[1:]] & word[:-1]
        before = np.zeros(n, bool)
        before[1:] = space[:-1]
        before[first] = False
        if self.cut == "word":
            begins = ~space & before
            begins[first] |= ~space[first]
            begins |= point[:n]
            # a chunk ends where white space follows or its text ends
            ends = point
            ends[1:n] |= space[1:] & ~space[:-1]
            last = offsets[1:][offsets[:-1] < offsets[1:]]
            ends[last] |= ~space[last - 1]
            return np.flatnonzero(begins), np.flatnonzero(ends)
        after = np.zeros(n, bool)  # a word follows in the same text
        after[:-1] = ~space[1:]
        after[first - 1] = False
        after[n - 1 :] = False
        blank = np.zeros(n, bool)
        blank[1:] = data[:-1] == 32
        begins = space & ~before
        begins |= ~space & before & ~blank
        begins |= space & before & after
        begins |= point[:n]
        begins[first] = True
        start = np.flatnonzero(begins)
        return start, np.append(start[1:], n)

    def __call__(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        counts = np.zeros(len(texts), np.int64)
        odd = [i for i, x in enumerate(texts) if x and self.rare.search(x)]
        if odd:
            return self._mixed(texts, odd, counts)
        if self.cut == "piece":
            full = np.flatnonzero(offsets[:-1] < offsets[1:])
            data = np.insert(data, offsets[full], np.uint8(32))
            offsets = offsets + np.concatenate(([0], np.cumsum(offsets[:-1] < offsets[1:])))
        if not len(data):
            return np.empty(0, np.uint32), counts
        if self.cut == "word":
            data = _LOWER[data]
        start, end = self._bounds(data, offsets)
        if not len(start):
            return np.empty(0, np.uint32), counts
        hashes = self.hash.ranges(data, start, end) | np.uint64(1)
        slot = (hashes >> np.uint64(7)).astype(np.int64) & (len(self.key) - 1)
        begin, size = self.start[slot], self.length[slot].astype(np.int64)
        miss = np.flatnonzero(self.key[slot] != hashes)
        flat = self.flat
        if len(miss):
            _, at, which = np.unique(hashes[miss], return_index=True, return_inverse=True)
            new = miss[at]
            raw = data.tobytes()
            ids, sizes = self.encode([raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat[: self.used], np.empty(max(len(self.flat), len(ids)), np.uint32)))
            flat = self.flat
            flat[self.used : self.used + len(ids)] = ids
            ends = np.cumsum(sizes)
            first = self.used + ends - sizes
            begin[miss], size[miss] = first[which], sizes[which]
            # only empty places are filled, the ids of the others are forgotten after this call
            _, lead = np.unique(slot[new], return_index=True)
            lead = lead[(self.key[slot[new[lead]]] == 0) & (sizes[lead] < 1000)]
            lead.sort()
            kept, n = slot[new[lead]], sizes[lead]
            self.key[kept], self.length[kept] = hashes[new[lead]], n
            self.start[kept] = self.used + np.cumsum(n) - n
            chosen = flat[ragged(first[lead], n)]
            flat = flat[ragged(begin, size)]  # a copy, made before the transient ids go
            self.flat[self.used : self.used + len(chosen)] = chosen
            self.used += len(chosen)
        else:
            flat = flat[ragged(begin, size)]
        counts += np.bincount(np.searchsorted(offsets, start, "right") - 1, size, len(texts)).astype(np.int64)
        return flat, counts

    def _mixed(self, texts: list[str], odd: list[int], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts of both kinds: the odd ones whole, the others by chunks."""
        odd_ids = dict(zip(odd, self.whole([texts[i] for i in odd]), strict=True))
        rest = ["" if i in odd_ids else x for i, x in enumerate(texts)]
        raw = [x.encode() for x in rest]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        ids, n = self(rest, data, offsets)
        parts, at = [], 0
        for i in range(len(texts)):
            part = np.asarray(odd_ids[i], np.uint32) if i in odd_ids else ids[at : at + n[i]]
            at += n[i]
            parts.append(part)
            counts[i] = len(part)
        return np.concatenate(parts).astype(np.uint32), counts


@lru_cache(maxsize=1)
def library_encoder(path: str, cut: str) -> ChunkEncoder:
    """A ChunkEncoder over a vocabulary file of the tokenizers library, which encodes each chunk. A worker keeps the last one from task to task, until `forget_encoder`."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    # a text that spells a special token holds it, wherever its chunks would end
    marks = sorted((re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    rare = re.compile("|".join([_RARE_SPACE.pattern, *marks]))

    def whole(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = whole([x.decode() for x in chunks])
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((y for x in got for y in x), np.uint32, int(sizes.sum())), sizes

    if cut != "space":
        mark, sign = " \x01 ", b"\x01"
        (stop,) = whole(["\x01"])[0][:1] or [-1]

        def marked(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            """Chunks without the mark go in long texts with the mark, one id of its own, between them."""
            ids, sizes = [], []
            for a in range(0, len(chunks), 512):
                some = chunks[a : a + 512]
                if any(sign in x for x in some):
                    got, n = encode(some)
                else:
                    got = np.array(tokenizer.encode((mark.join(x.decode() for x in some)) + mark, add_special_tokens=False).ids, np.uint32)
                    ends = np.flatnonzero(got == stop)
                    n = np.diff(ends, prepend=-1) - 1
                    got = np.delete(got, ends)
                ids.append(got)
                sizes.append(n)
            return np.concatenate(ids), np.concatenate(sizes)

        return ChunkEncoder(marked, whole, cut, rare)
    spelled = tokenizer.get_vocab()
    width = np.zeros(max(spelled.values()) + 1, np.int64)  # the byte alphabet has a letter for each byte
    for piece, i in spelled.items():
        width[i] = len(piece)

    def joined(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that start with white space and hold more are cut apart in any text, so they go in a few long ones."""
        fit = np.fromiter((x[0] in b" \t\n\r" and not x.isspace() for x in chunks), bool, len(chunks))
        rows, parts = np.flatnonzero(fit), []
        sizes = np.zeros(len(chunks), np.int64)
        for a in range(0, len(rows), 512):
            some = rows[a : a + 512]
            ids = np.array(tokenizer.encode(b"".join(chunks[i] for i in some.tolist()).decode(), add_special_tokens=False).ids, np.uint32)
            ends = np.cumsum(np.fromiter((len(chunks[i]) for i in some.tolist()), np.int64, len(some)))
            at = np.searchsorted(np.cumsum(width[ids]), ends) + 1
            sizes[some] = np.diff(at, prepend=0)
            parts.append(ids)
        rest = np.flatnonzero(~fit)
        alone, sizes[rest] = encode([chunks[i] for i in rest.tolist()])
        order = np.concatenate((rows, rest))
        first = np.zeros(len(chunks), np.int64)
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate((*parts, alone)).astype(np.uint32)[ragged(first, sizes)], sizes

    return ChunkEncoder(joined, whole, cut, rare)


def forget_encoder() -> None:
    """Workers outlive stages: one that takes up work without a vocabulary lets go of the encoder (and its ids of chunks) that an earlier stage has left."""
    library_encoder.cache_clear()
