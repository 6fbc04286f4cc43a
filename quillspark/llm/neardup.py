"""Near duplicates by a chosen-path similarity join over minwise tokens.

Each text becomes the set of its distinct word shingles; equal sets are one class. In each of
several independent trees a node selects some of the minwise tokens, one or two so that their number is 1 / threshold on
average, and a class branches into the child of each one's value. So similar classes lose a common child now and then and win a second
one as often, and the chance that they still share a node falls slowly with depth. Four levels are walked at once, where nodes of unrelated
texts hold one class; further levels follow as long as a node is large. Small nodes are compared exhaustively by their sketches, and every candidate is
confirmed on the full sets. Links between texts that other links already join add nothing to
the components, so a node gives a spanning forest of its candidates first, and a large node, at the full
depth, each member's nearest of some pivots. Where that leaves more than one component in a node, its members outside the largest
one are held against all others in blocks that carry the full sets: only confirmed links come out, one for each two components that they
join. So no pairs of a group become rows, and of the pairs that share a node none is left untried that could join two components.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize, new_path, temporary
from .batches import text_slices
from .chunked import _Hash, forget_encoder
from .components import components, merged

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
TOKENS = 256
_rng = np.random.default_rng(11)
_SCALE, _SHIFT = _rng.integers(1, 1 << 32, TOKENS, dtype=np.uint32) | np.uint32(1), _rng.integers(0, 1 << 32, TOKENS, dtype=np.uint32)
#: Classes whose sets are wanted, at most, to send their ids to the scan of the texts; beyond, texts are shuffled to them.
BROADCAST_ROWS = 1 << 20
#: Nodes whose lists of pivots are sent to the rows of dense nodes; beyond, both are shuffled by node.
BROADCAST_NODES = 1 << 10
#: A member's bytes without its set, about.
MEMBER_BYTES = 320
#: Members and bytes of a block, about: blocks of a node are held against each other.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Bytes of the members outside the largest components of nodes of several blocks that are sent to all blocks; beyond, both are shuffled by node and block.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class NearDup:
    """Parameters: `words` a shingle, link when 100 * intersection >= `percent` * union.

    trees and depth give the recall: see `recall`. With 10 trees at depth 4 and 5 it is 0.99995 and 0.9998 at least for 0.85, 0.9998 and 0.9993 for 0.80;
    no node goes deeper. small: the largest node that is compared exhaustively. A sketch estimate may lie four standard deviations of 256 tokens below the threshold.
    """

    words: int = 5
    percent: int = 80
    trees: int = 10
    first: int = 4
    depth: int = 5
    small: int = 256
    pivots: int = 16

    @property
    def bound(self) -> float:
        p = self.percent / 100
        return p - 4 * (p * (1 - p) / TOKENS) ** 0.5

    @property
    def second(self) -> float:
        """The chance that a node selects a second token: their number is 1 / threshold on average."""
        return min(1.0, 100 / self.percent - 1)

    def recall(self, similarity: float, depth: int) -> float:
        """The chance that a pair shares a node at this depth in some tree."""
        share = 1.0
        for _ in range(depth):
            apart = 1 - similarity * share
            share = 1 - ((1 - self.second) * apart + self.second * apart * apart)
        return 1 - (1 - share) ** self.trees


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles: A-Z lower-cased, words parted by ASCII white space."""

    def __init__(self, words: int) -> None:
        self.words, self.hash = words, _Hash()

    def __call__(self, text: str | None) -> np.ndarray:
        data = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        inside = np.concatenate(([False], ~_SPACE[data], [False]))
        start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        if not len(start):
            return np.empty(0, np.uint64)
        word = _mix(self.hash.ranges(data, start, end))
        k = min(self.words, len(word))
        n = len(word) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = _mix(out * np.uint64(3) + word[i : i + n])
        return np.unique(out)


def _tokens(shingles: np.ndarray) -> np.ndarray:
    """8 bits of each minwise value."""
    least = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 256):
        np.minimum(least, (short[i : i + 256, None] * _SCALE + _SHIFT).min(0), out=least)
    return _mix(least.astype(np.uint64)).astype(np.uint8)


def _digest(shingles: bytes) -> tuple[int, ...]:
    """128 bits of a set, as two numbers."""
    return struct.unpack("<2q", hashlib.blake2b(shingles, digest_size=16).digest())


def _similar(x: bytes, y: bytes, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sets."""
    both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _alike(equal: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal tokens: unequal values agree in 8 bits once in 256 times."""
    return (equal * 256 - 1) / 255


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, class_id and proof (digest of the set; null for an empty one), tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoder()
        shingler = Shingler(words)
        for part in text_slices(batches):
            sets = [shingler(x) for x in part.column("text").to_pylist()]
            ids = [_digest(x.tobytes()) if len(x) else (None, None) for x in sets]
            columns = [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(x, pa.int64()) for x in (zip(*ids, strict=True) if ids else ((), ()))), pa.array([_tokens(x).tobytes() if len(x) else None for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "class_id", "proof", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, class_id long, proof long, tokens binary")


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sketches, and one row per distinct set: class_id, proof, lead, copies, n, tokens; both written.

    Sets are told apart by 128 bits: the few whose first 64 are equal, and whose proofs are not, take another class_id.
    """
    while True:
        every = rows.where("class_id is not null").groupBy("class_id").agg(
            F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"), F.min("proof").alias("proof"), F.max("proof").alias("other")
        )
        classes = materialize(every, "classes")
        clash = classes.where("proof <> other").select("class_id", F.lit(True).alias("clash"))
        if clash.isEmpty():
            return rows, classes.drop("other")
        moved = rows.join(clash, "class_id", "left").withColumn("class_id", F.when(F.col("clash"), F.xxhash64("class_id", "proof")).otherwise(F.col("class_id"))).drop("clash")
        rows = materialize(moved, "sketches")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, TOKENS)


def _descend(node: np.ndarray, tokens: np.ndarray, own: np.ndarray, p: NearDup) -> tuple[np.ndarray, np.ndarray]:
    """The children of each node on the paths of its classes, and the class (row of tokens) of each; own: the classes of the nodes.

    Which tokens are selected depends on the path so far.
    """
    draw = _mix(node + np.uint64(1))
    pick = draw % np.uint64(TOKENS)
    draw = _mix(draw)
    more = np.flatnonzero((draw >> np.uint64(11)).astype(np.float64) < p.second * float(1 << 53))
    other = (pick[more] + np.uint64(1) + _mix(draw[more]) % np.uint64(TOKENS - 1)) % np.uint64(TOKENS)
    own, node, pick = np.append(own, own[more]), np.append(node, node[more]), np.append(pick, other)
    return _mix(_mix(node * np.uint64(3) + pick) + tokens[own, pick.astype(np.int64)].astype(np.uint64)), own


def _roots(classes: DataFrame, p: NearDup) -> DataFrame:
    """node (at the first depth), class_id for every class, tree and path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _matrix(batch.column("tokens"))
            ids = batch.column("class_id").to_numpy()
            for tree in range(p.trees):
                node, own = _mix(np.full(len(tokens), tree + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.arange(len(tokens))
                for _ in range(p.first):
                    node, own = _descend(node, tokens, own, p)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids[own])], names=["node", "class_id"])

    return classes.select("class_id", "tokens").mapInArrow(run, "node long, class_id long")


def _children(members: DataFrame, p: NearDup) -> DataFrame:
    """node, class_id one level further down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node, own = _descend(batch.column("node").to_numpy().view(np.uint64), _matrix(batch.column("tokens")), np.arange(batch.num_rows), p)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(batch.column("class_id").to_numpy()[own])], names=["node", "class_id"])

    return members.select("node", "class_id", "tokens").mapInArrow(run, "node long, class_id long")


def _sized(rows: DataFrame, p: NearDup, last: bool) -> DataFrame:
    """Rows of nodes with more than one member, with the node's size; written.

    Trees bring the same classes together again and again: of nodes where paths end (small ones, or all at the `last` depth) that have the same members one is
    kept, since another has no pair that this one lacks. Large nodes that are walked on are all kept, since their children differ. Members are told by 128 bits.
    """
    same = [F.bit_xor("class_id").alias("x"), F.bit_xor(F.xxhash64("class_id")).alias("y")]
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), *same).where("size > 1")
    walked = F.when((F.col("size") > p.small) & F.lit(not last), F.col("node"))
    one = sizes.groupBy("size", "x", "y", walked.alias("walked")).agg(F.min("node").alias("node"))
    return materialize(rows.join(one.select("node", "size"), "node"), "members")


def _described(members: DataFrame, classes: DataFrame) -> DataFrame:
    return members.join(classes.select("class_id", "n", "tokens"), "class_id")


def _terminal(rows: DataFrame, classes: DataFrame, p: NearDup) -> DataFrame:
    """Members of the nodes where paths end: small ones, and those still large at the full depth; written with size, n and tokens."""
    done, members = [], _sized(rows, p, p.first == p.depth)
    for level in range(p.first, p.depth + 1):
        large = members.where(F.col("size") > p.small)
        if level == p.depth or large.isEmpty():
            done.append(members)
            break
        done.append(members.where(F.col("size") <= p.small))
        members = _sized(materialize(_children(_described(large, classes), p), "children"), p, level + 1 == p.depth)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return materialize(_described(out, classes).select("node", "class_id", "size", "n", "tokens"), "nodes")


def _candidates(m: list[dict], p: NearDup) -> np.ndarray:
    """Of all pairs of a small node's members the estimate, or 0 where it or the sizes of the sets rule a link out."""
    tokens = np.frombuffer(b"".join(x["tokens"] for x in m), np.uint8).reshape(-1, TOKENS)
    n = np.array([x["n"] for x in m], np.int64)
    like = _alike((tokens[:, None, :] == tokens[None, :, :]).mean(2, dtype=np.float32))
    fits = (like >= p.bound) & (100 * np.minimum(n[:, None], n) >= p.percent * np.maximum(n[:, None], n))
    return np.triu(np.where(fits, like, 0), 1)


_PAIRS = ["a", "b"]


def _pair_batch(found: list[tuple], names: list[str] = _PAIRS) -> pa.RecordBatch:
    kinds = {"extra": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kinds.get(c, pa.int64())) for i, c in enumerate(names)], names=names)


def _forest(members: DataFrame, p: NearDup) -> DataFrame:
    """a, b, node, extra: a spanning forest of each small node's candidates, best first, and whether it has others."""
    lists = members.where(F.col("size") <= p.small).groupBy("node").agg(F.collect_list(F.struct("class_id", "n", "tokens")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            # a list at a time, so that the objects of a whole batch are never held
            for node, some in zip(batch.column("node").to_pylist(), batch.column("m"), strict=True):
                m = sorted(some.as_py(), key=lambda x: x["class_id"])
                like = _candidates(m, p)
                i, j = np.nonzero(like)
                top = list(range(len(m)))

                def find(x: int, top: list[int] = top) -> int:
                    while top[x] != x:
                        top[x] = x = top[top[x]]
                    return x

                own = []
                for k in np.argsort(-like[i, j], kind="stable").tolist():
                    a, b = int(i[k]), int(j[k])
                    if (x := find(a)) != (y := find(b)):
                        top[x] = y
                        own.append((m[a]["class_id"], m[b]["class_id"]))
                found += [(a, b, node, len(own) < len(i)) for a, b in own]
            yield _pair_batch(found, ["a", "b", "node", "extra"])

    return lists.select("node", "m").mapInArrow(run, "a long, b long, node long, extra boolean")


def _against(rows: DataFrame, p: NearDup, best: int) -> DataFrame:
    """a, b of a row's class and the classes in its list `m` of another component that are candidates; of those the `best` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for c, comp, n, raw, some in zip(*(batch.column(x).to_pylist() for x in ("class_id", "component", "n", "tokens")), batch.column("m"), strict=True):
                m = [x for x in some.as_py() if x["component"] != comp and 100 * min(n, x["n"]) >= p.percent * max(n, x["n"])]
                if not m:
                    continue
                like = _alike((np.frombuffer(b"".join(x["tokens"] for x in m), np.uint8).reshape(-1, TOKENS) == np.frombuffer(raw, np.uint8)).mean(1))
                at = np.flatnonzero(like >= p.bound)
                for k in at[np.argsort(-like[at], kind="stable")][:best].tolist():
                    found.append((min(c, m[k]["class_id"]), max(c, m[k]["class_id"])))
            yield _pair_batch(found)

    return rows.select("class_id", "component", "n", "tokens", "m").mapInArrow(run, "a long, b long")


def _pivoted(dense: DataFrame, p: NearDup) -> DataFrame:
    """a, b: each member of a dense node with the two nearest of the node's pivots."""
    slot = F.pmod(F.xxhash64("class_id", "node"), F.lit(p.pivots))
    one = dense.groupBy("node", slot.alias("slot")).agg(F.min_by(F.struct("class_id", F.col("class_id").alias("component"), "n", "tokens"), F.xxhash64("class_id")).alias("pivot"))
    lists = materialize(one.groupBy("node").agg(F.collect_list("pivot").alias("m")), "pivots")
    if lists.count() <= BROADCAST_NODES:
        lists = F.broadcast(lists)
    return _against(dense.withColumn("component", F.col("class_id")).join(lists, "node"), p, 2)


def _outside(labelled: DataFrame) -> DataFrame:
    """node, main, blocks, parts, rest_bytes: each node with more than one component, its largest component, and the blocks that all members and those outside it fill; written."""
    counts = labelled.groupBy("node", "component").agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("n") * 8 + MEMBER_BYTES).alias("bytes"))
    largest = F.struct("members", "component")
    nodes = counts.groupBy("node").agg(
        F.max_by("component", largest).alias("main"), F.sum("members").alias("members"), F.sum("bytes").alias("bytes"), (F.sum("members") - F.max("members")).alias("rest"), (F.sum("bytes") - F.max_by("bytes", largest)).alias("rest_bytes")
    )
    blocks = lambda members, bytes_: F.ceil(F.greatest(F.col(members) / BLOCK, F.col(bytes_) / BLOCK_BYTES)).cast("int")
    return materialize(nodes.where("rest > 0").select("node", "main", blocks("members", "bytes").alias("blocks"), blocks("rest", "rest_bytes").alias("parts"), "rest_bytes"), "outside")


def _links_across(labelled: DataFrame, nodes: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """a, b: links across the components of each node that full sets confirm, as many as join them.

    Members come with their sets, so that pairs never become rows: a node of one block is a row; in a larger one each block of
    those outside the largest component meets each block of all in a row of its own. Within a row the best candidates are tried first, and none
    between components that the links found there have joined; every other candidate is tried.
    """
    member = F.struct("class_id", "component", "n", "tokens", "shingles")
    block = lambda count: F.pmod(F.xxhash64("class_id", "node"), F.col(count)).cast("int")
    open_ = labelled.join(nodes, "node").join(sets, "class_id")
    every = open_.groupBy("node", block("blocks").alias("block"), "main", "blocks").agg(F.collect_list(member).alias("m"))
    single = every.where("blocks = 1").select(F.lit(None).cast(every.schema["m"].dataType).alias("few"), "m", "main")
    # said before the join, so that nodes of one block aren't shuffled for it
    several = every.where("blocks > 1")
    few = open_.where("blocks > 1 AND component <> main").groupBy("node", block("parts").alias("part"), "blocks").agg(F.collect_list(member).alias("few"))
    if (nodes.where("blocks > 1").agg(F.sum("rest_bytes")).first()[0] or 0) <= BROADCAST_BYTES:
        met = several.join(F.broadcast(few.select("node", "few")), "node")
    else:
        # dealt by block, so that no node lands in one task
        met = several.join(few.select("node", "few", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), ["node", "block"])

    def members(lists: pa.ListArray) -> list[tuple]:
        flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ids, comps, n, tokens = *(flat.field(x).to_numpy() for x in ("class_id", "component", "n")), _matrix(flat.field("tokens"))
        raw, ends = flat.field("shingles"), np.cumsum(sizes).tolist()
        return [(ids[a:b], comps[a:b], n[a:b], tokens[a:b], raw[a:b]) for a, b in zip([0, *ends], ends)]

    def joins(x: tuple, y: tuple, main: int) -> Iterator[tuple[int, int]]:
        (ids, comps, n, tokens, raw), (ids2, comps2, n2, tokens2, raw2) = x, y
        rows, columns, likes = [], [], []
        for i in range(len(ids)):
            # the bytes of a word sum up by themselves: 32 at most
            like = _alike((tokens2 == tokens[i]).view(np.uint64).sum(1).view(np.uint8).reshape(-1, 8).sum(1) / TOKENS)
            # two members outside the largest component meet twice, there and back
            once = (comps2 == main) | (ids2 > ids[i])
            at = np.flatnonzero((like >= p.bound) & (comps2 != comps[i]) & once & (100 * np.minimum(n2, n[i]) >= p.percent * np.maximum(n2, n[i])))
            rows.append(np.full(len(at), i))
            columns.append(at)
            likes.append(like[at])
        if not sum(map(len, rows)):
            return
        row, column, top = np.concatenate(rows), np.concatenate(columns), {}

        def find(c: int) -> int:
            while (up := top.get(c, c)) != c:
                top[c] = top.get(up, up)
                c = up
            return c

        for k in np.argsort(-np.concatenate(likes), kind="stable").tolist():
            i, j = int(row[k]), int(column[k])
            u, v = find(int(comps[i])), find(int(comps2[j]))
            if u != v and _similar(raw[i].as_py(), raw2[j].as_py(), p.percent):
                top[u] = v
                yield min(ids[i], ids2[j]), max(ids[i], ids2[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone = batch.column("few").is_null().to_pylist()
            for main, one, x, y in zip(batch.column("main").to_pylist(), alone, members(batch.column("few")), members(batch.column("m")), strict=True):
                if one:
                    out = np.flatnonzero(y[1] != main)
                    x = tuple(c[out] for c in y[:4]) + (y[4].take(pa.array(out)),)
                if found := list(joins(x, y, main)):
                    yield _pair_batch(found)

    return single.unionByName(met.select("few", "m", "main")).mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """class_id, shingles (sorted 64-bit hashes) of the wanted classes (class_id, proof, lead)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for part in text_slices(batches):
            sets = [shingler(x).tobytes() for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("class_id"), part.column("proof"), pa.array([_digest(x)[1] for x in sets], pa.int64()), pa.array(sets, pa.binary())], names=["class_id", "proof", "found", "shingles"])

    ids = wanted.select(F.col("lead").alias("doc_id"), "class_id", "proof")
    if wanted.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    leads = docs.select("doc_id", "text").join(ids, "doc_id").select("class_id", "proof", "text")
    # a repeated doc_id may lead to another text, or twice to the same one
    found = leads.mapInArrow(run, "class_id long, proof long, found long, shingles binary").where("proof = found")
    return found.groupBy("class_id").agg(F.first("shingles").alias("shingles"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that the full sets confirm; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = [_similar(x.as_py(), y.as_py(), percent) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    x = sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("y"))
    return materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored): doc_id, n_shingles, component_id, kept, class_id.

    component_id is the smallest doc_id reachable by links, kept says that it is the row's own. Null, empty
    and blank texts have no shingles and are linked with nothing. Rows of equal text belong together even when a
    doc_id is repeated; a null doc_id is never smallest, and such a row isn't kept. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows, moved, end = materialize(sketches(docs, p.words), "sketches"), new_path(spark, "sketches"), new_path(spark, "named")
    with temporary(spark):
        told, classes = _classes(rows)
        joined = _joined(docs, classes, p)
        lead = classes.select("class_id", "lead", "copies").join(joined.withColumnRenamed("node", "class_id"), "class_id", "left")
        group = materialize(lead.where("component is not null").groupBy("component").agg(F.min("lead").alias("least")), "groups")
        named = lead.where("component is not null or copies > 1").join(group, "component", "left").select("class_id", F.coalesce("least", "lead").alias("least"))
        if told is not rows:
            rows = materialize(told, "sketches", moved)
        named = materialize(named, "named", end)
    component = F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("least", "doc_id"))
    out = rows.select("doc_id", "n_shingles", "class_id").join(named, "class_id", "left")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "class_id")


def _joined(docs: DataFrame, classes: DataFrame, p: NearDup) -> DataFrame:
    """class_id as node, component: of all classes that confirmed links join to others."""
    # classes with a null lead can't be read again by id; they keep to themselves
    known = classes.where("lead is not null")
    members = _terminal(_roots(known, p), known, p)
    dense = members.where(F.col("size") > p.small)
    forest = materialize(_forest(members, p), "forest")
    first = forest.select(*_PAIRS)
    if not dense.isEmpty():
        first = first.unionByName(_pivoted(dense, p))
    first = materialize(first.distinct(), "pairs")
    # every class with a candidate is in a forest, or in a dense node
    ids = first.select(F.col("a").alias("class_id")).unionByName(first.select(F.col("b").alias("class_id"))).unionByName(dense.select("class_id")).distinct()
    sets = materialize(_sets(docs, materialize(ids.join(known.select("class_id", "proof", "lead"), "class_id"), "wanted"), p.words), "sets")
    joined = components(_confirmed(first, sets, p.percent))
    # an edge that leads to two components isn't a link: the other candidates of its node are tried; so are all of dense nodes
    edges = _component_of(_component_of(forest.where("extra"), joined, "a"), joined, "b")
    again = edges.where("a_component <> b_component").select("node").distinct()
    small = members.where(F.col("size") <= p.small).join(again, "node", "left_semi")
    labelled = materialize(_labelled(dense.unionByName(small), joined), "labelled")
    outside = _outside(labelled)
    if outside.isEmpty():
        return joined
    return merged(joined, materialize(_links_across(labelled, outside, sets, p), "links"))


def _component_of(rows: DataFrame, joined: DataFrame, column: str) -> DataFrame:
    """`rows` with the component of the class in `column`, which is the class itself where nothing joins it."""
    found = joined.select(F.col("node").alias(column), F.col("component").alias("found"))
    return rows.join(found, column, "left").withColumn(f"{column}_component", F.coalesce("found", column)).drop("found")


def _labelled(members: DataFrame, joined: DataFrame) -> DataFrame:
    return _component_of(members, joined, "class_id").withColumnRenamed("class_id_component", "component")
