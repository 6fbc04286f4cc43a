"""Filtering Lloyd: trees, clusters and vector codes against SQL, brute force and edge cases."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import centroids, kdtree, queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, cluster string"
NAN, INF = float("nan"), float("inf")


def brute(v, book, rounds):
    for _ in range(rounds):
        near = ((v[:, None] - book) ** 2).sum(2).argmin(1)
        book = np.stack([v[near == i].sum(0) // (near == i).sum() if (near == i).any() else b for i, b in enumerate(book)])
    far = ((v[:, None] - book) ** 2).sum(2)
    return far.argmin(1), far.min(1), book


@pytest.mark.parametrize("leaf", [1, 3, 32])
@pytest.mark.parametrize("scale", [2, 100, 1 << 24])  # many ties, few, and integers beyond exact doubles
def test_tree_equals_brute_force(leaf, scale):
    rng = np.random.default_rng(leaf)
    centre = rng.integers(-scale, scale, (6, 5))
    for n in (1, 2, 7, 300):
        v = centre[rng.integers(0, 6, n)] + rng.integers(-scale // 2, scale // 2 + 1, (n, 5))
        book = v[rng.integers(0, n, 9)]  # repeated entries too
        tree = kdtree.KdTree.build(v, leaf)
        far = ((v[:, None] - book) ** 2).sum(2)
        entry, distance = tree.assigned(book)
        assert (entry == far.argmin(1)).all() and (distance == far.min(1)).all()
        counts, sums = tree.totals(book)
        assert counts.tolist() == np.bincount(far.argmin(1), minlength=9).tolist()
        assert (sums == np.stack([v[far.argmin(1) == i].sum(0) for i in range(9)])).all()


def test_whole_subtrees_are_assigned_in_clustered_data():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(0, 50, (1000, 4)) + 10_000 * i for i in range(4)])
    nodes, _, rows, _ = kdtree.KdTree.build(v).filtered(np.array([[10_000 * i + 20] * 4 for i in range(4)]))
    assert len(rows) < 100 and len(nodes) < 40


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_clusters"])
@pytest.mark.parametrize("bad", [False, True])
def test_vector_query_equals_sql(spark, sf, tmp_path, name, bad):
    if bad:  # rows that go, repeated ids, null labels, ties
        table = spark.read.parquet(f"{sf}/embeddings.parquet")
        x = [float(i % 5) for i in range(64)]
        rows = [(-1, None, 1), (-2, [], 1), (-3, [*x[:-1], NAN], 1), (-4, [*x[:-1], INF], 1), (-5, [*x[:-1], None], 1), (-6, x[:-1], 1), (-7, [-INF] * 64, 2)]
        rows += [(-8, [-y for y in x], None), (-9, x, None), (-9, x, 3), (-9, x, 3), (900, [y / 7 for y in x], None)]
        table.unionByName(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).write.parquet(f"{tmp_path}/embeddings.parquet")
        sf, path = str(tmp_path), f"{tmp_path}/embeddings.parquet/*.parquet"
    else:
        path = f"{sf}/embeddings.parquet"
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{path}'")
    got = queries.QUERIES[name](spark, sf)
    want = duck.execute(f"select {', '.join(got.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_vector_operators_on_small_and_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([(1, None, 1, "x", "y"), (2, [NAN], None, "x", "y"), (None, [], 1, None, None)], SCHEMA)
    for df in (empty, none):
        assert centroids.clusters(df).collect() == [] and vector_codes.code_vectors(df).collect() == []
        assert centroids.clusters(df).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    # one row, twice, without an id; columns of the result's names are ignored
    same = spark.createDataFrame([(None, [0.5] * 64, None, "x", "y")] * 2, SCHEMA)
    sha = lambda n: hashlib.sha256(",".join(["512"] * n if n == 64 else ["2048"] * n).encode()).hexdigest()
    assert [tuple(r) for r in centroids.clusters(same).collect()] == [(None, 0, 0, 0, 0, sha(64))] * 2
    assert [tuple(r) for r in vector_codes.code_vectors(same).collect()] == [(None, "00" * 8, 0, 0, sha(128))] * 2
    wide = spark.createDataFrame([(1, [1e30] * 64, 1, "x", "y")], SCHEMA)
    for run in (centroids.clusters, vector_codes.code_vectors):
        with pytest.raises(Exception, match="too large for exact distances"):
            run(wide).collect()


def test_vector_results_do_not_depend_on_partitions_or_joins(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("label", F.when(F.col("label") > 2, F.col("label")))
    plain = sorted(map(tuple, vector_codes.code_vectors(df).collect()), key=repr)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 1)
    monkeypatch.setattr(kdtree, "BLOCK_ROWS", 37)
    assert sorted(map(tuple, vector_codes.code_vectors(df.repartition(5)).collect()), key=repr) == plain
    v = np.floor(np.array([r.embedding for r in df.orderBy("vec_id").collect()], float) * 1024).astype(np.int64)
    order = sorted(range(len(v)), key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:5]
    near, far, _ = brute(v, v[order], 4)
    got = centroids.clusters(df.repartition(3), k=5, rounds=4).orderBy("vec_id").collect()
    assert [(r.cluster, r.distance) for r in got] == list(zip(near.tolist(), far.tolist(), strict=True))
