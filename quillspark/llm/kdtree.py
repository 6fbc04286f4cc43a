"""Filtering Lloyd: kd-trees with cached counts, sums and boxes, built once in each partition and filtered in every round.

A partition's vectors come in blocks of bounded size. A block is one row of a written table and holds a balanced kd-tree for each part
of its vectors: points in the tree's order and, for every node, the box and the sum of its points. In a round the
trees are walked from the root with the entries of a codebook as candidates. An entry goes where another one is strictly
nearer to every point of the node's box, a node with one entry left counts as a whole by its cached sums, and
the points of leaves with several are told apart exactly. Only counts and sums of entries leave a task. All is
done in integers (or in doubles that hold them exactly), so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize

#: Vectors of a block, at most.
BLOCK_ROWS = 8192
#: Points of a leaf, at most.
LEAF = 32
#: Components must be below: then squared distances of 64 components fit a long.
WIDEST = 1 << 27
#: Distances that a leaf step holds at once, about.
DISTANCES = 1 << 20
_ARRAYS = {"points": np.int32, "place": np.int32, "low": np.int32, "high": np.int32, "sums": np.int64}


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def whole(vector: Column) -> Column:
    """Whether a vector is there and holds neither null nor NaN nor an infinity."""
    # null and NaN fail the comparison: NaN counts as larger than any number
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))), F.lit(False))


class KdTree:
    """A balanced kd-tree over the rows of an integer matrix; node i has the children 2i+1 and 2i+2, and all leaves are on one level."""

    def __init__(self, points: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray) -> None:
        """points in the tree's order, place: where each was; low, high, sums by node."""
        self.points, self.place, self.low, self.high, self.sums = points, place, low, high, sums
        self.depth = (len(low) + 1).bit_length() - 2

    @classmethod
    def build(cls, rows: np.ndarray, leaf: int = LEAF) -> KdTree:
        n, depth, leaf = len(rows), 0, max(leaf, 2)  # so that no node is empty
        while n > leaf << depth:
            depth += 1
        place = np.arange(n)
        for level in range(depth):
            cuts, at = cls._cuts(n, level), rows[place]
            widest = (np.maximum.reduceat(at, cuts[:-1]) - np.minimum.reduceat(at, cuts[:-1])).argmax(1)
            node = np.repeat(np.arange(1 << level), np.diff(cuts))
            place = place[np.lexsort((at[np.arange(n), widest[node]], node))]
        points, starts = rows[place], cls._cuts(n, depth)[:-1]
        levels = [(np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts), np.add.reduceat(points, starts))]
        while len(levels[0][0]) > 1:
            low, high, sums = levels[0]
            levels.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), sums[::2] + sums[1::2]))
        return cls(points, place, *(np.concatenate(x) for x in zip(*levels, strict=True)))

    @staticmethod
    def _cuts(n: int, level: int) -> np.ndarray:
        """Where the nodes of a level begin, and the end."""
        return n * np.arange((1 << level) + 1) >> level

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 point of each node."""
        cuts = [self._cuts(len(self.points), level) for level in range(self.depth + 1)]
        return np.concatenate([c[:-1] for c in cuts]), np.concatenate([c[1:] for c in cuts])

    def filtered(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes that belong to one entry as a whole, their entries; the points of the other leaves, and their nearest entries (ties: the smallest)."""
        most = max(int(np.abs(self.points).max(initial=0)), int(np.abs(entries).max(initial=0)))
        # doubles are exact, and multiplied faster, as long as no sum reaches 2**53
        kind = np.float64 if 8 * most * most * self.points.shape[1] < 1 << 53 else np.int64
        e = entries.astype(kind)
        squares = (e * e).sum(1)
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(e)), bool)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(self.depth + 1):
            low, high = self.low[nodes].astype(kind), self.high[nodes].astype(kind)
            # twice the box's middle stays an integer; its nearest candidate is held against the others
            middle = squares - (low + high) @ e.T
            best = np.where(open_, middle, np.inf if kind is np.float64 else np.iinfo(np.int64).max).argmin(1)
            for b in np.unique(best):
                at = np.flatnonzero(best == b)
                way = e - e[b]
                # of the box's points the one that lies farthest the other entry's way
                reach = high[at] @ np.maximum(way, 0).T + low[at] @ np.minimum(way, 0).T
                open_[at] &= squares - squares[b] - 2 * reach <= 0
            one = open_.sum(1) == 1
            done.append((nodes[one], best[one]))
            nodes, open_ = nodes[~one], open_[~one]
            if level < self.depth:
                nodes, open_ = np.stack((2 * nodes + 1, 2 * nodes + 2), 1).ravel(), np.repeat(open_, 2, 0)
        first, last = self.spans()
        rows, nearest = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        step = max(1, DISTANCES // (LEAF * len(e)))
        for a in range(0, len(nodes), step):
            some, size = nodes[a : a + step], last[nodes[a : a + step]] - first[nodes[a : a + step]]
            at = np.repeat(first[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
            far = squares - 2 * (self.points[at].astype(kind) @ e.T)
            far[~np.repeat(open_[a : a + step], size, 0)] = np.inf if kind is np.float64 else np.iinfo(np.int64).max
            rows.append(at)
            nearest.append(far.argmin(1))
        return np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done]), np.concatenate(rows), np.concatenate(nearest)

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and componentwise sum of the points of each entry."""
        nodes, owners, rows, nearest = self.filtered(entries)
        first, last = self.spans()
        counts = np.bincount(nearest, minlength=len(entries))
        sums = np.zeros(entries.shape, np.int64)
        np.add.at(counts, owners, (last - first)[nodes])
        np.add.at(sums, owners, self.sums[nodes])
        for i in np.unique(nearest):
            sums[i] += self.points[rows[nearest == i]].sum(0, dtype=np.int64)
        return counts, sums

    def assigned(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row, in the rows' own order."""
        nodes, owners, rows, nearest = self.filtered(entries)
        first, last = self.spans()
        entry = np.empty(len(self.points), np.int64)
        for a, b, i in zip(first[nodes].tolist(), last[nodes].tolist(), owners.tolist(), strict=True):
            entry[a:b] = i
        entry[rows] = nearest
        back = np.empty_like(entry)
        back[self.place] = np.arange(len(entry))
        away = self.points.astype(np.int64) - entries[entry]
        return entry[back], (away * away).sum(1)[back]


def tree_blocks(vectors: DataFrame, parts: int, length: int) -> DataFrame:
    """Blocks of the rows of `vectors` (vector: array of `length` longs, and what else is carried along), each with a tree for each of the `parts`; written."""
    carried = [c for c in vectors.columns if c != "vector"]
    width = length // parts

    def block(rows: pa.RecordBatch) -> pa.RecordBatch:
        flat = rows.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)
        if (most := max(int(flat.max()), -int(flat.min()))) >= WIDEST:
            raise ValueError(f"a component of {most} is too large for exact distances in 64 bits")
        trees = [KdTree.build(flat[:, i * width : (i + 1) * width]) for i in range(parts)]
        ends = pa.array([0, rows.num_rows], pa.int32())
        columns = [pa.array([[getattr(t, x).astype(kind).tobytes() for t in trees]], pa.list_(pa.binary())) for x, kind in _ARRAYS.items()]
        return pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays(ends, rows.column(c)) for c in carried), *columns], names=[*carried, *_ARRAYS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, BLOCK_ROWS - n)
                batch = batch.slice(some.num_rows)
                held.append(some)
                n += some.num_rows
                if n == BLOCK_ROWS:
                    yield block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    kinds = [f"`{c}` array<{vectors.schema[c].dataType.simpleString()}>" for c in carried]
    return materialize(vectors.mapInArrow(run, ", ".join([*kinds, *(f"{x} array<binary>" for x in _ARRAYS)])), "trees")


def _trees(batch: pa.RecordBatch, width: int) -> Iterator[list[KdTree]]:
    """The trees of each block of a batch, by part."""
    for row in zip(*(batch.column(x) for x in _ARRAYS), strict=True):
        parts = zip(*(x.values for x in row), strict=True)
        yield [KdTree(*(np.frombuffer(x.as_buffer(), kind).reshape(*((-1,) if name == "place" else (-1, width))) for x, (name, kind) in zip(part, _ARRAYS.items(), strict=True))) for part in parts]


def lloyd(blocks: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The codebooks (one for each part: entries x components) after `rounds` of assignment to the nearest entry and floored means; entries without points stay.

    Counts and sums of all entries, a table as large as the codebooks, come to the driver in each round.
    """
    width = books[0].shape[1]

    def totals(books: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [np.zeros((len(b), width + 1), np.int64) for b in books]
            for batch in batches:
                for trees in _trees(batch, width):
                    for mine, tree, book in zip(own, trees, books, strict=True):
                        counts, sums = tree.totals(book)
                        mine[:, 0] += counts
                        mine[:, 1:] += sums
            for part, mine in enumerate(own):
                entry, column = np.nonzero(mine)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), part, np.int32)), pa.array(entry.astype(np.int32)), pa.array(column.astype(np.int32)), pa.array(mine[entry, column])], names=["part", "entry", "column", "total"])

        return run

    for _ in range(rounds):
        found = blocks.select(*_ARRAYS).mapInArrow(totals(books), "part int, entry int, column int, total long")
        sums = found.groupBy("part", "entry", "column").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        known = {(r.part, r.entry, r.column): int(r.total) for r in sums.collect()}
        books = [b.copy() for b in books]
        for part, book in enumerate(books):
            for entry in range(len(book)):
                if count := known.get((part, entry, 0), 0):
                    book[entry] = [known.get((part, entry, 1 + i), 0) // count for i in range(width)]
    return books


def assignments(blocks: DataFrame, books: list[np.ndarray], made: str, schema: str, carried: list[str]) -> DataFrame:
    """`carried` columns of every vector, then those of `schema`: made, and the squared distance summed over its parts.

    made: "entry" (the index in the only book) or "code" (two hexadecimal digits for each part).
    """
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, trees in enumerate(_trees(batch, width)):
                entries, far = zip(*(t.assigned(b) for t, b in zip(trees, books, strict=True)), strict=True)
                if made == "code":
                    spelled, n = np.stack(entries, 1).astype(np.uint8).tobytes().hex(), 2 * len(books)
                    first = pa.array([spelled[i : i + n] for i in range(0, len(spelled), n)], pa.string())
                else:
                    first = pa.array(entries[0].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, 1).flatten() for c in carried), first, pa.array(sum(far))], names=[*carried, made, "distance"])

    kinds = [f"`{c}` {blocks.schema[c].dataType.elementType.simpleString()}" for c in carried]
    return blocks.select(*carried, *_ARRAYS).mapInArrow(run, ", ".join([*kinds, schema]))
