"""Set similarity join of texts on word n-grams by vertical partitioning.

A global order puts rare n-grams before frequent ones. It is cut into fragments, and with it every set into segments. For a
candidate pair the segments of a fragment give a partial overlap, fragment by fragment in rows of their own, and the sum
of a pair's partial overlaps decides. So no task holds two whole sets, and long texts are shared out.

The first fragment counts for every set how many of its n-grams no other set has. Where these are more than a link may lack, the set can
link with none and goes no further: so n-grams that unrelated texts share by chance cost nothing, however many texts there are.

Candidates: texts that link share an n-gram among the first of both in the order (as many as may be missing, and one). Texts that share
such an n-gram form a list; of a list's pairs the sizes and the parity bitmaps of the sets rule most out exactly, since two
bitmaps differ in no more bits than the sets in elements. Links between texts that others already join add nothing to the
components. So a list gives spanning forests of its candidates, one at first and more in later rounds, long lists a pairing
with pivots first and then blocks of members outside the largest component against all. Rounds end when each candidate left joins
texts of one component: no pairs of a group become rows, and no link that could join two components is left untried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize, new_path, task_partitions, temporary
from .batches import text_slices
from .components import merged
from .neardup import Shingler, _classes, _component_of, _digest, _sets

#: The share of the hashes that is the first fragment to be counted, a fourth, and the shuffle partitions of the session for which it has a part.
COUNTED, PARTITIONS_A_PART = 0.25, 8
#: N-grams that the order knows as frequent, at most: the most frequent ones; others go by their hashes.
FREQUENT = 1 << 16
#: N-grams counted at once in a task, and the count there from which one is reported.
WINDOW, REPORTED = 1 << 21, 4
#: Members and bytes of a block, about; a list that is longer is paired with pivots first.
BLOCK, BLOCK_BYTES = 256, 1 << 20
PIVOTS = 16
#: Lists whose pivots are sent to all members, and bytes of members outside the largest components that are sent to all blocks; beyond, both are shuffled.
BROADCAST_LISTS, BROADCAST_BYTES = 1 << 10, 8 << 20
#: Bits of a bitmap: the power of two from twice the set's size on, within these.
BITS = (256, 1 << 18)


@dataclass(frozen=True)
class NgramJoin:
    """Parameters: `words` an n-gram, link when 100 * intersection >= `percent` * union, `fragments` of the order (the last holds the frequent n-grams)."""

    words: int = 5
    percent: int = 80
    fragments: int = 8


class Order:
    """The global order: by reported count (none before any), then by hash."""

    def __init__(self, grams: np.ndarray, seen: np.ndarray) -> None:
        self.grams, self.seen = grams, seen

    def counts(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, self.seen[at], 0)

    def first(self, grams: np.ndarray, n: int) -> np.ndarray:
        """The first `n` of a sorted set."""
        return grams[np.argsort(self.counts(grams), kind="stable")[:n]]

    def fragment(self, grams: np.ndarray, fragments: int) -> np.ndarray:
        """Where the order's cuts put each: ranges of hashes for rare ones, the last fragment for frequent ones."""
        rare = (grams >> np.uint64(32)) * np.uint64(fragments - 1) >> np.uint64(32)
        return np.where(self.counts(grams) > 0, fragments - 1, rare.astype(np.int64))


def _counts(docs: DataFrame, words: int, parts: int) -> DataFrame:
    """Two kinds of rows, from one scan of all texts: gram and seen, for an n-gram that many sets of a window hold; and part, ids, sizes, held, grams, for the first fragment.

    The latter are the COUNTED share of the hashes, cut into parts: the sets of a window (ids, sizes), how many n-grams each has in the part, and these
    one after another as five bytes. Every set comes with each part that it has n-grams in, and with the first part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size = Shingler(words), {}, 0
        names, kinds = ["gram", "seen", "part", "ids", "sizes", "held", "grams"], [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]

        def row(part: int, ids: np.ndarray, sizes: np.ndarray, n: np.ndarray, grams: np.ndarray) -> pa.RecordBatch:
            values = [None, None, part, ids.tobytes(), sizes.tobytes(), n.astype(np.int32).tobytes(), grams.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        def window() -> Iterator[pa.RecordBatch]:
            sets = list(held.values())
            every = np.concatenate(sets)
            grams, seen = np.unique(every, return_counts=True)
            often = seen >= REPORTED
            columns = [pa.array(grams[often].view(np.int64)), pa.array(seen[often]), *(pa.nulls(int(often.sum()), k) for k in kinds[2:])]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            ids, sizes = np.array([x[0] for x in held], np.int64), np.array([len(x) for x in sets], np.int64)
            owner, first = np.repeat(np.arange(len(sets)), sizes), every >> np.uint64(40) < np.uint64(COUNTED * (1 << 24))
            owner, every = owner[first], every[first]
            # within a set n-grams are sorted, so those of a part stay together
            part = ((every >> np.uint64(32)) * np.uint64(parts) // np.uint64(COUNTED * (1 << 32))).astype(np.int64)
            for i in range(parts):
                mine = part == i
                n = np.bincount(owner[mine], minlength=len(sets))
                here = n > 0 if i else np.ones(len(sets), bool)
                if here.any():
                    yield row(i, ids[here], sizes[here], n[here], every[mine].view(np.uint8).reshape(-1, 8)[:, 3:])

        for part in text_slices(batches):
            for x in part.column("text").to_pylist():
                grams = shingler(x)
                if len(grams) and (key := _digest(grams.tobytes())) not in held:
                    held[key] = grams
                    size += len(grams)
            if size >= WINDOW:
                yield from window()
                held, size = {}, 0
        if held:
            yield from window()

    return materialize(docs.select("text").mapInArrow(run, "gram long, seen long, part int, ids binary, sizes binary, held binary, grams binary"), "counts")


def _order(seen: DataFrame) -> Order:
    """The order of rows gram, seen. At most FREQUENT of them come to the driver."""
    seen = materialize(seen.groupBy("gram").agg(F.sum("seen").alias("seen")), "seen")
    level = F.floor(F.log2(F.col("seen").cast("double")) * 4).cast("int")
    left, least = FREQUENT, None
    for r in sorted(seen.groupBy(level.alias("level")).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r.level
    rows = seen.where(level >= least).collect() if least is not None else []
    grams, counts = np.array([r.gram for r in rows], np.int64).view(np.uint64), np.array([r.seen for r in rows], np.int64)
    by = np.argsort(grams)
    return Order(grams[by], counts[by])


def _alone(counts: DataFrame, percent: int, parts: int) -> DataFrame:
    """class_id of the sets that can link with none: of their n-grams in the first fragment more belong to no other set than a link may lack; written.

    Each part counts what its sets lack there; the counts of all parts are summed by buckets of sets, as many as there are parts. Only five bytes of an n-gram are compared, so now and then one counts as shared that isn't, and a set is kept for nothing.
    """

    def part(rows: pa.Table) -> pa.Table:
        whole = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
        ids, sizes, held = whole("ids", np.int64), whole("sizes", np.int64), whole("held", np.int32)
        grams = np.zeros((int(held.sum()), 8), np.uint8)
        grams[:, :5] = whole("grams", np.uint8).reshape(-1, 5)
        # a set that several windows saw is one
        own, first, owner = np.unique(ids, return_index=True, return_inverse=True)
        owner, grams = np.repeat(owner, held), grams.view(np.uint64).ravel()
        by = np.lexsort((owner, grams))
        owner, grams = owner[by], grams[by]
        new = np.append(True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1]))[: len(grams)]
        owner, grams = owner[new], grams[new]
        same = grams[1:] == grams[:-1]
        shared = np.append(False, same) | np.append(same, False) if len(grams) else np.empty(0, bool)
        sizes, lacking = sizes[first], np.bincount(owner[~shared], minlength=len(own))
        bucket = (own.view(np.uint64) % np.uint64(parts)).astype(np.int64)
        some = [(i, at) for i in range(parts) if len(at := np.flatnonzero(bucket == i))]
        columns = [pa.array([i for i, _ in some], pa.int32()), *(pa.array([x[at].tobytes() for _, at in some], pa.binary()) for x in (own, sizes, lacking))]
        return pa.table(columns, names=["bucket", "ids", "sizes", "lacking"])

    def bucket(rows: pa.Table) -> pa.Table:
        ids, sizes, lacking = (np.frombuffer(b"".join(rows.column(name).to_pylist()), np.int64) for name in ("ids", "sizes", "lacking"))
        own, first, owner = np.unique(ids, return_index=True, return_inverse=True)
        every = np.bincount(owner, lacking, len(own)).astype(np.int64)
        return pa.table({"class_id": own[100 * every > (100 - percent) * sizes[first]]})

    per = counts.where("part is not null").select("part", "ids", "sizes", "held", "grams").groupBy("part").applyInArrow(part, "bucket int, ids binary, sizes binary, lacking binary")
    return materialize(per.groupBy("bucket").applyInArrow(bucket, "class_id long"), "alone")


def _width(n: Column) -> Column:
    """Bytes of the bitmap of a set of this size."""
    power = F.pow(F.lit(2.0), F.length(F.bin(2 * n - 1)))
    return (F.least(F.greatest(power, F.lit(float(BITS[0]))), F.lit(float(BITS[1]))) / 8).cast("int")


def _bits(grams: np.ndarray) -> np.ndarray:
    """Parities of how many elements fall on each bit, packed."""
    width = min(max(1 << (2 * len(grams) - 1).bit_length(), BITS[0]), BITS[1])
    return np.packbits((np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(bool))


def _described(docs: DataFrame, order: Order, p: NgramJoin) -> DataFrame:
    """doc_id, n_shingles, class_id and proof (digest of the set; null for an empty one), tokens: the bitmap and then the first n-grams in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(p.words)
        for part in text_slices(batches):
            sets = [shingler(x) for x in part.column("text").to_pylist()]
            ids = [_digest(x.tobytes()) if len(x) else (None, None) for x in sets]
            tokens = [_bits(x).tobytes() + order.first(x, len(x) - -(-p.percent * len(x) // 100) + 1).tobytes() if len(x) else None for x in sets]
            columns = [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64()), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "class_id", "proof", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, class_id long, proof long, tokens binary")


def _lists(classes: DataFrame) -> DataFrame:
    """gram, class_id, size: the members of each list of two and more, each set of members once; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("first")]
            if first:
                owner = np.repeat(batch.column("class_id").to_numpy(), [len(x) for x in first])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(owner)], names=["gram", "class_id"])

    rest = F.expr("substring(tokens, width + 1)")
    postings = classes.select("class_id", "tokens", _width(F.col("n")).alias("width")).select("class_id", rest.alias("first")).mapInArrow(run, "gram long, class_id long")
    sizes = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(postings.join(sizes, "gram"), "members")
    # lists of equal members are told by 128 bits
    one = members.groupBy("gram").agg(F.first("size").alias("size"), *(F.bit_xor(F.xxhash64(F.lit(i), "class_id")).alias(f"mark{i}") for i in range(2)))
    kept = one.groupBy("size", "mark0", "mark1").agg(F.min("gram").alias("gram")).select("gram")
    return materialize(members.join(kept, "gram"), "lists")


def _labelled(members: DataFrame, classes: DataFrame, joined: DataFrame | None) -> DataFrame:
    """`members` with n, bits and the component of the class."""
    about = classes.select("class_id", "n", F.expr("substring(tokens, 1, width)").alias("bits"))
    rows = members.join(about, "class_id")
    return _component_of(rows, joined, "class_id").withColumnRenamed("class_id_component", "component") if joined is not None else rows.withColumn("component", F.col("class_id"))


class _Members:
    """Arrays of a list of members; bitmaps by their width."""

    def __init__(self, rows: pa.StructArray) -> None:
        self.ids, self.components, self.n = (rows.field(x).to_numpy() for x in ("class_id", "component", "n"))
        bits = rows.field("bits")
        sizes = pc.binary_length(bits).to_numpy()
        self.by_width = {int(w): ((at := np.flatnonzero(sizes == w)), np.frombuffer(b"".join(bits.take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1)) for w in np.unique(sizes)}

    def only(self, keep: np.ndarray) -> _Members:
        out = object.__new__(_Members)
        out.ids, out.components, out.n = self.ids[keep], self.components[keep], self.n[keep]
        new = np.cumsum(keep) - 1
        out.by_width = {w: (new[at[keep[at]]], bits[keep[at]]) for w, (at, bits) in self.by_width.items() if keep[at].any()}
        return out


def _candidates(x: _Members, y: _Members, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in x and y of the pairs of different components that may link, and the least share of elements that they differ in."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for w, (at, bits) in x.by_width.items():
        for w2, (at2, bits2) in y.by_width.items():
            own, other = bits, bits2
            while own.shape[1] > other.shape[1]:  # a narrower bitmap of a set is a wider one folded
                own = own[:, : own.shape[1] // 2] ^ own[:, own.shape[1] // 2 :]
            while other.shape[1] > own.shape[1]:
                other = other[:, : other.shape[1] // 2] ^ other[:, other.shape[1] // 2 :]
            step = max(1, (1 << 18) // (other.shape[0] * other.shape[1]))
            for a in range(0, len(at), step):
                i = at[a : a + step]
                n, n2 = x.n[i][:, None], y.n[at2]
                fits = (x.components[i][:, None] != y.components[at2]) & (100 * np.minimum(n, n2) >= percent * np.maximum(n, n2))
                if not fits.any():
                    continue
                differ = np.bitwise_count(own[a : a + step, None] ^ other).sum(2, dtype=np.int64)
                common = (n + n2 - differ) // 2
                fits &= 100 * common >= percent * (n + n2 - common)
                row, column = np.nonzero(fits)
                out.append((i[row], at2[column], differ[row, column] / (n + n2)[row, column]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Places of the edges u-v, taken in their order, that join what those before leave apart."""
    names, both = np.unique(np.concatenate((u, v)), return_inverse=True)
    u, v, top, at, kept = both[: len(u)], both[len(u) :], np.arange(len(names)), np.arange(len(u)), []
    while len(at):
        for k in at[:1024].tolist():
            a, b = int(u[k]), int(v[k])
            while top[a] != a:
                top[a] = a = top[top[a]]
            while top[b] != b:
                top[b] = b = top[top[b]]
            if a != b:
                top[a] = b
                kept.append(k)
        at = at[1024:]
        while (up := top[top] != top).any():
            top[up] = top[top[up]]
        at = at[top[u[at]] != top[v[at]]]
    return np.array(kept, np.int64)


_PAIR = "a long, b long, n_a long, n_b long, gram long, more boolean"


def _pairs_of(gram: int, x: _Members, y: _Members, main: int, forests: int, percent: int) -> pa.RecordBatch | None:
    """Edges of that many forests of the candidates between x, outside the component `main`, and y, nearest first, and whether there are more."""
    i, j, apart = _candidates(x, y, percent)
    # two members outside meet twice, here or in two rows
    once = (y.components[j] == main) | (x.ids[i] < y.ids[j])
    i, j, apart = i[once], j[once], apart[once]
    if not len(i):
        return None
    order = np.lexsort((np.maximum(x.ids[i], y.ids[j]), np.minimum(x.ids[i], y.ids[j]), apart))
    i, j = i[order], j[order]
    chosen, rest = [], np.arange(len(i))
    for _ in range(forests):
        if not len(rest):
            break
        edges = _forest(x.components[i[rest]], y.components[j[rest]])
        chosen.append(rest[edges])
        rest = np.delete(rest, edges)
    at = np.concatenate(chosen)
    turn = x.ids[i[at]] > y.ids[j[at]]
    a, b = (x.ids[i[at]], x.n[i[at]]), (y.ids[j[at]], y.n[j[at]])
    columns = [*(np.where(turn, b[k], a[k]) for k in range(2)), *(np.where(turn, a[k], b[k]) for k in range(2))]
    columns = [columns[0], columns[2], columns[1], columns[3], np.full(len(at), gram), np.full(len(at), len(rest) > 0)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "n_a", "n_b", "gram", "more"])


_MEMBER = ["class_id", "component", "n", "bits"]


def _pivoted(long: DataFrame, percent: int) -> DataFrame:
    """Pairs of each member of long lists with the likeliest of its list's pivots."""
    slot = F.pmod(F.xxhash64("class_id", "gram"), F.lit(PIVOTS))
    lists = long.groupBy("gram", slot.alias("slot")).agg(F.min_by(F.struct(*_MEMBER), F.xxhash64("class_id")).alias("pivot")).groupBy("gram").agg(F.collect_list("pivot").alias("m"))
    lists = materialize(lists, "pivots")
    # members come by blocks, so that a list's pivots are sent once a block
    blocks = long.groupBy("gram", F.pmod(F.xxhash64("class_id", "gram"), F.ceil(F.col("size") / BLOCK)).alias("block")).agg(F.collect_list(F.struct(*_MEMBER)).alias("few"))
    met = blocks.join(F.broadcast(lists) if lists.count() <= BROADCAST_LISTS else lists, "gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, few, m in zip(batch.column("gram").to_pylist(), batch.column("few"), batch.column("m"), strict=True):
                x, y = _Members(few.values), _Members(m.values)
                i, j, apart = _candidates(x, y, percent)
                if len(i):
                    by = np.lexsort((j, apart, i))
                    best = by[np.append(True, np.diff(i[by]) > 0)]
                    # pairs of one member each, so all are kept
                    a, b = x.ids[i[best]], y.ids[j[best]]
                    n, n2, turn = x.n[i[best]], y.n[j[best]], a > b
                    columns = [np.where(turn, b, a), np.where(turn, a, b), np.where(turn, n2, n), np.where(turn, n, n2), np.full(len(best), gram), np.ones(len(best), bool)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "n_a", "n_b", "gram", "more"])

    return met.select("gram", "few", "m").mapInArrow(run, _PAIR)


def _across(labelled: DataFrame, forests: int, percent: int) -> DataFrame:
    """Pairs of each list's members outside its largest component with all others, in blocks."""
    weight = F.length("bits") + 64
    counts = labelled.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("members"), F.sum(weight).alias("bytes"))
    largest = F.struct("members", "component")
    nodes = counts.groupBy("gram").agg(
        F.max_by("component", largest).alias("main"), F.sum("members").alias("members"), F.sum("bytes").alias("bytes"), (F.sum("members") - F.max("members")).alias("rest"), (F.sum("bytes") - F.max_by("bytes", largest)).alias("rest_bytes")
    )
    blocks = lambda members, bytes_: F.ceil(F.greatest(F.col(members) / BLOCK, F.col(bytes_) / BLOCK_BYTES)).cast("int")
    nodes = materialize(nodes.where("rest > 0").select("gram", "main", blocks("members", "bytes").alias("blocks"), blocks("rest", "rest_bytes").alias("parts"), "rest_bytes"), "open")
    block = lambda count: F.pmod(F.xxhash64("class_id", "gram"), F.col(count)).cast("int")
    open_ = labelled.join(nodes, "gram")
    every = open_.groupBy("gram", block("blocks").alias("block"), "main", "blocks").agg(F.collect_list(F.struct(*_MEMBER)).alias("m"))
    single = every.where("blocks = 1").select("gram", F.lit(None).cast(every.schema["m"].dataType).alias("few"), "m", "main")
    few = open_.where("blocks > 1 AND component <> main").groupBy("gram", block("parts").alias("part"), "blocks").agg(F.collect_list(F.struct(*_MEMBER)).alias("few"))
    if (nodes.where("blocks > 1").agg(F.sum("rest_bytes")).first()[0] or 0) <= BROADCAST_BYTES:
        met = every.where("blocks > 1").join(F.broadcast(few.select("gram", "few")), "gram")
    else:
        # dealt by block, so that no list lands in one task
        met = every.where("blocks > 1").join(few.select("gram", "few", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), ["gram", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, few, m, main in zip(batch.column("gram").to_pylist(), batch.column("few"), batch.column("m"), batch.column("main").to_pylist(), strict=True):
                y = _Members(m.values)
                x = _Members(few.values) if few.is_valid else y.only(y.components != main)
                if (pairs := _pairs_of(gram, x, y, main, forests, percent)) is not None:
                    yield pairs

    return single.unionByName(met.select("gram", "few", "m", "main")).mapInArrow(run, _PAIR)


def _segments(sets: DataFrame, order: Order, p: NgramJoin) -> DataFrame:
    """class_id, fragment, segment: each set (class_id, shingles) cut where the order is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, where, parts = [], [], []
            for c, raw in zip(batch.column("class_id").to_pylist(), batch.column("shingles"), strict=True):
                grams = np.frombuffer(raw.as_buffer(), np.uint64)
                at = order.fragment(grams, p.fragments)
                for f in np.unique(at).tolist():
                    ids.append(c)
                    where.append(f)
                    parts.append(grams[at == f].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(where, pa.int32()), pa.array(parts, pa.binary())], names=["class_id", "fragment", "segment"])

    return materialize(sets.select("class_id", "shingles").mapInArrow(run, "class_id long, fragment int, segment binary"), "segments")


def _confirmed(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs whose partial overlaps sum up to a link; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                both = np.concatenate((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
                both.sort(kind="stable")
                common.append(int((both[1:] == both[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "n_a", "n_b")), pa.array(common, pa.int64())], names=["a", "b", "n_a", "n_b", "common"])

    x = segments.select(F.col("class_id").alias("a"), "fragment", F.col("segment").alias("x"))
    y = segments.select(F.col("class_id").alias("b"), "fragment", F.col("segment").alias("y"))
    partial = pairs.join(x, "a").join(y, ["b", "fragment"]).select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(run, "a long, b long, n_a long, n_b long, common long")
    sums = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
    return materialize(sums.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b"), "links")


def _joined(docs: DataFrame, classes: DataFrame, order: Order, p: NgramJoin) -> DataFrame:
    """class_id as node, component: of all classes that links join to others."""
    # classes with a null lead can't be read again by id; they keep to themselves
    known = materialize(classes.where("lead is not null").withColumn("width", _width(F.col("n"))), "known")
    members = _lists(known)
    joined = segments = tried = None
    forests, rows = 1, members.where(F.col("size") <= BLOCK)
    long = members.where(F.col("size") > BLOCK)
    while True:
        labelled = _labelled(rows, known, joined)
        if joined is not None:
            labelled = materialize(labelled, "labelled")
        found = _across(labelled, forests, p.percent)
        if joined is None:
            pivoted = not long.isEmpty()
            if pivoted:
                found = found.unionByName(_pivoted(materialize(_labelled(long, known, None), "long"), p.percent))
        found = materialize(found, "pairs")
        fresh = found.select("a", "b", "n_a", "n_b").distinct()
        fresh = materialize(fresh if tried is None else fresh.join(tried, ["a", "b"], "left_anti"), "fresh")
        ids = fresh.select(F.col("a").alias("class_id")).unionByName(fresh.select(F.col("b").alias("class_id"))).distinct()
        if segments is not None:
            ids = ids.join(segments.select("class_id").distinct(), "class_id", "left_anti")
        wanted = materialize(ids.join(known.select("class_id", "proof", "lead"), "class_id"), "wanted")
        if not wanted.isEmpty():
            more = _segments(_sets(docs, wanted, p.words), order, p)
            segments = more if segments is None else segments.unionByName(more)
        if segments is None:
            links = fresh.select("a", "b").limit(0)
        else:
            links = _confirmed(fresh, segments, p.percent)
        first, joined = joined is None, merged(joined, links)
        tried = fresh.select("a", "b") if tried is None else tried.unionByName(fresh.select("a", "b"))
        # a list is done when its candidates are links, or lead within components
        ends = _component_of(_component_of(found.where("more").select("a", "b", "gram"), joined, "a"), joined, "b")
        again = ends.where("a_component <> b_component").select("gram")
        if first and pivoted:
            # pivots aren't all candidates: long lists are done only within one component
            own = _component_of(long.select("gram", "class_id"), joined, "class_id").groupBy("gram").agg(F.min("class_id_component").alias("least"), F.max("class_id_component").alias("most"))
            again = again.unionByName(own.where("least <> most").select("gram"))
        again = materialize(again.distinct(), "again")
        if again.isEmpty():
            return joined
        rows = members.join(again, "gram", "left_semi")
        forests = 1 if first and pivoted else 4 * forests


def jaccard_components(docs: DataFrame, p: NgramJoin = NgramJoin()) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, n_shingles, component_id, class_id (equal sets have one).

    component_id is the smallest doc_id reachable by links. Null, empty and blank texts have no n-grams and are linked with nothing; a text of fewer
    words than an n-gram is one n-gram. Rows of equal text belong together even when a doc_id is repeated; a null doc_id is never
    smallest. An empty table gives no rows. The result is exact: every pair that reaches the threshold is in one component.
    """
    spark, end = docs.sparkSession, new_path(docs.sparkSession, "components")
    with temporary(spark):
        parts = max(1, task_partitions(docs) // PARTITIONS_A_PART)
        counts = _counts(docs, p.words, parts)
        order, alone = _order(counts.where("gram is not null").select("gram", "seen")), _alone(counts, p.percent, parts)
        rows, classes = _classes(materialize(_described(docs, order, p), "described"))
        joined = _joined(docs, classes.join(alone, "class_id", "left_anti"), order, p)
        lead = classes.select("class_id", "lead", "copies").join(joined.withColumnRenamed("node", "class_id"), "class_id", "left")
        group = materialize(lead.where("component is not null").groupBy("component").agg(F.min("lead").alias("least")), "groups")
        named = materialize(lead.where("component is not null or copies > 1").join(group, "component", "left").select("class_id", F.coalesce("least", "lead").alias("least")), "named")
        component = F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("least", "doc_id"))
        out = rows.select("doc_id", "n_shingles", "class_id").join(named, "class_id", "left")
        return materialize(out.select("doc_id", "n_shingles", component.alias("component_id"), "class_id"), "components", end)
