"""Nearest neighbours by cosine from a hash-prefix forest.

A vector has a long string of hyperplane bits in every tree, and a tree is the sorted array of its rows' strings. A query
descends in each tree to its longest matching prefix; then all trees ascend together until a row as near as the k-th
one found would have been met with probability 1 - MISS, given how far the query lies from each plane. So data whose rows
have near neighbours end at long prefixes, and the share that is scored falls as rows grow.

Rows are dealt by the first bits of a routing string into cells, each a shard of bounded size or several; the forest of a shard is
built once and written. A query searches its own cell first. What it finds tells how likely a nearer row lies in each other
cell, and it goes on to the likeliest ones that hold ROUTE of the chance together.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import materialize, new_path, task_partitions
from .batches import file_system, publish, ragged

TREES = 64
BITS = 32
#: Chance that a row as near as the k-th found isn't met in a shard, and the chance that the cells searched hold it.
MISS, ROUTE = 0.1, 0.98
SHARD_ROWS = 16_384
QUERY_BLOCK = 8_192
#: Rows that the centre of the planes is taken from, at most.
SAMPLE_ROWS = 4_096


def _normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 4 digits."""
    z = np.clip(z, -8, 8)
    return 0.5 * (1 + np.tanh(0.7978845608 * z * (1 + 0.044715 * z * z)))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which changes no cosine, so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


class Planes:
    """`n` random planes of unit normals through a centre."""

    def __init__(self, centre: np.ndarray, n: int, seed: int) -> None:
        normals = np.random.default_rng((seed, len(centre))).standard_normal((len(centre), n))
        self.normals = normals / np.linalg.norm(normals, axis=0)
        self.cut = centre @ self.normals

    def sides(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.normals

    def agree(self, side: np.ndarray, cosine: float) -> np.ndarray:
        """The chance that a row at this cosine lies on the same side of each plane as the query whose projections are `side`."""
        free = max(1, len(self.normals) - 1)
        s = min(max(cosine, -0.999999), 0.999999)
        spread = np.sqrt((1 - s * s) * np.maximum(1 - side * side, 1e-9) / free)
        up = _normal((s * side - self.cut) / spread)
        return np.where(side > self.cut, up, 1 - up)


class Forest:
    """Sorted arrays of hash strings, one per tree, over the rows of a shard."""

    def __init__(self, rows: np.ndarray, planes: Planes, codes: np.ndarray | None = None, order: np.ndarray | None = None) -> None:
        self.rows, self.planes = rows, planes
        self.size = np.sqrt((rows * rows).sum(1))
        if codes is None:
            codes = self.codes(planes.sides(rows / self.size[:, None]))
            order = np.argsort(codes, axis=1, kind="stable")
            codes = np.take_along_axis(codes, order, 1)
        self.sorted, self.order = codes.astype(np.int64), order

    def codes(self, sides: np.ndarray) -> np.ndarray:
        """tree x row."""
        bits = (sides > self.planes.cut).reshape(len(sides), -1, BITS)
        return np.packbits(bits, axis=2).view(">u4")[:, :, 0].T.astype(np.int64)

    def _ranges(self, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of the queries' prefixes of this length, tree x query."""
        shift = BITS - length
        prefix = codes >> shift
        low, high = np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
        for t, own in enumerate(self.sorted):
            low[t] = np.searchsorted(own, prefix[t] << shift, "left")
            high[t] = np.searchsorted(own, (prefix[t] + 1) << shift, "left")
        return low, high

    def stop(self, side: np.ndarray, cosine: float) -> int:
        """The longest prefix at which the trees together miss a row at this cosine with a chance of MISS at most."""
        met = np.cumprod(self.planes.agree(side, cosine).reshape(-1, BITS), axis=1)
        fine = np.flatnonzero(np.log1p(-np.minimum(met, 1 - 1e-12)).sum(0) <= np.log(MISS))
        return int(fine[-1]) + 1 if len(fine) else 0

    def search(self, queries: np.ndarray, k: int, known: np.ndarray, chunk: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each query the rows that were scored, their cosines, and how many there are. known: a cosine that `k` rows elsewhere reach, or -1."""
        for first in range(0, len(queries), chunk):
            yield from self._ascend(queries[first : first + chunk], k, known[first : first + chunk])

    def _ascend(self, queries: np.ndarray, k: int, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        norms = np.sqrt((queries * queries).sum(1))
        sides = self.planes.sides(queries / norms[:, None])
        codes, flat = self.codes(sides), self.order.ravel()
        base = np.arange(len(self.order)) * len(self.rows)
        met = np.zeros((len(queries), len(self.rows)), bool)
        at, score = [np.empty(0, np.int64)] * len(queries), [np.empty(0)] * len(queries)
        # no query stops before its trees hold rows enough, which may be one row in every tree
        wanted, open_ = min(len(self.order) + 4 * k, len(self.rows)), np.arange(len(queries))
        for length in range(BITS, -1, -1):
            low, high = self._ranges(codes[:, open_], length)
            rest = []
            for j in np.flatnonzero((high - low).sum(0) >= (0 if length == 0 else wanted)).tolist():
                i = open_[j]
                fresh = np.zeros(len(self.rows), bool)
                fresh[flat[ragged(base + low[:, j], high[:, j] - low[:, j])]] = True
                fresh = np.flatnonzero(fresh & ~met[i])
                met[i, fresh] = True
                at[i] = np.append(at[i], fresh)
                score[i] = np.append(score[i], (self.rows[fresh] @ queries[i]) / (self.size[fresh] * norms[i]))
                best = max(float(known[i]), float(np.partition(score[i], -k)[-k]) if len(score[i]) >= k else -1.0)
                if best > -1 and self.stop(sides[i], best) >= length:
                    rest.append(j)
            open_ = np.delete(open_, rest)
            if not len(open_):
                break
        return zip(at, score, map(len, at))

    def dump(self, uri: str, **more: np.ndarray) -> None:
        buffer = io.BytesIO()
        np.savez(buffer, rows=self.rows, codes=self.sorted.astype(np.uint32), order=self.order.astype(np.uint32), **more)
        publish(uri, lambda out: out.write(buffer.getbuffer()))

    @classmethod
    def load(cls, uri: str, planes: Planes) -> tuple[Forest, dict]:
        fs, path = file_system(uri)
        with fs.open_input_file(path) as f:
            held = dict(np.load(io.BytesIO(f.read())))
        return cls(held["rows"], planes, held["codes"], held["order"]), held


def likely_cells(planes: Planes, side: np.ndarray, cosine: float) -> np.ndarray:
    """The cells that a row at this cosine from the query lies in with a chance of ROUTE together, likeliest first."""
    agree = planes.agree(side, cosine)
    cells, chance = np.zeros(1, np.int64), np.ones(1)
    least = (1 - ROUTE) / 10 / (1 << len(side))
    for own, p in zip((side > planes.cut).astype(np.int64), agree, strict=True):
        cells, chance = np.concatenate((2 * cells + own, 2 * cells + 1 - own)), np.concatenate((chance * p, chance * (1 - p)))
        cells, chance = cells[chance > least], chance[chance > least]
    order = np.argsort(-chance, kind="stable")
    return cells[order[: int(np.searchsorted(np.cumsum(chance[order]), ROUTE)) + 1]]


def _stack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return _scaled(np.array(column.to_pylist(), np.float64))


def _cell(sides: np.ndarray, planes: Planes) -> np.ndarray:
    out = np.zeros(len(sides), np.int64)
    for bit in (sides > planes.cut).T:
        out = 2 * out + bit
    return out


def _valid(vectors: DataFrame) -> DataFrame:
    """Rows with an id whose vector is not null or zero and has only finite components."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found of each row whose vec_id is divisible by `every`.

    `vectors` has vec_id and embedding; other columns are ignored. Rows with a null id, or a vector that is null, empty, zero
    or has null or non-finite components, take no part. Equal vectors are one entry of the index with their k + 1
    smallest ids, which is all that any query can use. Vectors of different lengths aren't compared. Rows that repeat an id and a vector
    count once; ties go to the smaller vec_id; an empty table gives no rows.
    """
    rows = _valid(vectors).withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit("second"), "embedding")).withColumn("dim", F.size("embedding"))
    key = ["k1", "k2"]
    classes = materialize(rows.groupBy(*key, "dim").agg(F.min("vec_id").alias("lead"), F.count(F.lit(1)).alias("n"), F.max(F.pmod("vec_id", F.lit(every)) == 0).alias("asks"), F.first("embedding").alias("embedding")), "vectors")
    more = materialize(classes.where("n > 1").select(*key), "repeated")
    salted = rows.join(more, key).select(*key, "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(32)).alias("salt")).distinct()
    for by in ([*key, "salt"], key):
        salted = salted.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = salted.groupBy(*key).agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    ids = materialize(classes.select(*key, "lead").join(ids, key, "left").select(*key, F.coalesce("ids", F.array("lead")).alias("ids")), "ids")

    total = classes.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    routing = max(0, (-(-total.n // SHARD_ROWS) - 1).bit_length())
    blocks = max(1, -(-total.q // QUERY_BLOCK))
    sample: dict[int, list] = {}
    for r in classes.select("dim", "embedding").orderBy("k1", "k2").limit(SAMPLE_ROWS).toLocalIterator():
        sample.setdefault(r.dim, []).append(r.embedding)
    middle = {}
    for dim, own in sample.items():
        x = _scaled(np.array(own, np.float64))
        middle[dim] = (x / np.linalg.norm(x, axis=1)[:, None]).mean(0)
    held: dict[tuple, Planes] = {}

    def planes(dim: int, n: int, seed: int) -> Planes:
        if (dim, n, seed) not in held:
            held[dim, n, seed] = Planes(middle.get(dim, np.zeros(dim)), n, seed)
        return held[dim, n, seed]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """With the cell of each row."""
        for batch in batches:
            dims, cells = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = _stack(batch.column("embedding").take(pa.array(at)))
                cells[at] = _cell(planes(dim, routing, 2).sides(x / np.sqrt((x * x).sum(1))[:, None]), planes(dim, routing, 2))
            yield batch.append_column("cell", pa.array(cells))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    placed = materialize(classes.mapInArrow(place, f"{fields}, cell long"), "placed")
    cells = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("salts"))
    folder = new_path(vectors.sparkSession, "forest")

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        dim, cell, salt = (x.as_py() for x in key)
        uri = f"{folder}/{dim}-{cell}-{salt}.npz"
        Forest(_stack(rows["embedding"]), planes(dim, TREES * BITS, 5)).dump(uri, **{c: rows[c].to_numpy() for c in ("k1", "k2", "lead")})
        return pa.table({"dim": pa.array([dim], pa.int32()), "cell": [cell], "path": [uri]})

    dealt = placed.join(cells, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("k2", "k1"), F.col("salts")).cast("int").alias("salt"), *key, "lead", "embedding")
    # numbers of tasks are given: rows are few bytes and much work, so that adaptive execution would put them in one
    tasks = task_partitions(vectors)
    shards = materialize(dealt.repartition(tasks, "dim", "cell", "salt").groupBy("dim", "cell", "salt").applyInArrow(build, "dim int, cell long, path string"), "shards")

    def search(group: tuple, queries: pa.Table) -> pa.Table:
        dim, path, _ = (x.as_py() for x in group)
        forest, own = Forest.load(path, planes(dim, TREES * BITS, 5))
        out: list[list] = [[] for _ in range(6)]
        q, q1, q2 = _stack(queries["embedding"]), queries["q1"].to_numpy(), queries["q2"].to_numpy()
        for i, (at, score, _) in enumerate(forest.search(q, k + 1, queries["known"].to_numpy())):
            best = np.lexsort((own["lead"][at], -score))[: k + 1]
            n, at = len(best), at[best]
            for column, values in zip(out, (np.full(n, q1[i]), np.full(n, q2[i]), own["k1"][at], own["k2"][at], own["lead"][at], score[best]), strict=True):
                column.append(values)
        kinds = [pa.int64()] * 5 + [pa.float64()]
        return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, kinds, strict=True)], names=["q1", "q2", "k1", "k2", "lead", "score"])

    def searched(asked: DataFrame) -> DataFrame:
        """The best k + 1 of each shard for queries (dim, cell, q1, q2, embedding, known)."""
        block = F.pmod(F.xxhash64("q1", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
        sent = asked.join(shards, ["dim", "cell"]).select("dim", "path", block, "q1", "q2", "embedding", "known")
        found = sent.repartition(tasks, "dim", "path", "block").groupBy("dim", "path", "block").applyInArrow(search, "q1 long, q2 long, k1 long, k2 long, lead long, score double")
        best = found.withColumn("r", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "lead"))).where(F.col("r") <= k + 1).drop("r")
        return materialize(best, "found")

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries with each other cell that they go to."""
        for batch in batches:
            rows, to = [], []
            x, known = _stack(batch.column("embedding")) if batch.num_rows else None, batch.column("known").to_numpy()
            for i, (dim, own) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("cell").to_pylist(), strict=True)):
                p = planes(dim, routing, 2)
                more = likely_cells(p, p.sides(x[i] / np.sqrt((x[i] * x[i]).sum())), known[i]) if known[i] > -1 else np.arange(1 << routing)
                more = more[more != own]
                rows.append(np.full(len(more), i))
                to.append(more)
            if rows:
                out = batch.take(pa.array(np.concatenate(rows)))
                yield out.set_column(out.schema.get_field_index("cell"), "cell", pa.array(np.concatenate(to)))

    schema = "dim int, cell long, q1 long, q2 long, embedding " + classes.schema["embedding"].dataType.simpleString() + ", known double"
    asked = placed.where("asks").select("dim", "cell", F.col("k1").alias("q1"), F.col("k2").alias("q2"), "embedding")
    found = searched(asked.withColumn("known", F.lit(-1.0)))
    if routing:
        reached = found.groupBy("q1", "q2").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).otherwise(F.lit(-1.0)).alias("known"))
        again = asked.join(reached, ["q1", "q2"], "left").select("dim", "cell", "q1", "q2", "embedding", F.coalesce("known", F.lit(-1.0)).alias("known"))
        found = found.unionByName(searched(again.mapInArrow(elsewhere, schema)))
    merged = found.withColumn("r", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "lead"))).where(F.col("r") <= k + 1)
    merged = materialize(merged.join(ids, key).select("q1", "q2", "score", "ids"), "found")
    answers = materialize(merged.groupBy("q1", "q2").agg(F.collect_list(F.struct("score", "ids")).alias("found")), "answers")

    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2")).distinct()
    each = queries.join(answers, ["q1", "q2"])
    pairs = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct((-f["score"]).alias("far"), i.alias("vec_id")))))
    ranked = each.select("query_id", F.slice(F.array_sort(F.array_distinct(F.filter(pairs, lambda p: p["vec_id"] != F.col("query_id")))), 1, k).alias("near"))
    return ranked.select("query_id", F.posexplode("near").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
