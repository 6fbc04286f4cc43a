"""Centroid clustering by kd-tree filtering, in exact integers."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize, new_path, temporary
from .kdtree import assignments, integers, lloyd, tree_blocks, whole

LENGTH, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
_SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector of `vectors` (vec_id, embedding; others are ignored).

    Kept are vectors of exactly `length` components, none null, NaN or infinite; other rows (null and empty vectors too) aren't in the result.
    The first centroids are the kept vectors with the smallest sha256 of "seed:vec_id"; rows of one vec_id are told apart by
    their vectors, equal rows may both be taken, and a null vec_id comes last. With fewer than `k` vectors there are fewer centroids, with none
    no rows. A vector at equal distances goes to the smaller number. A component of 2**27 or more after scaling is an error, as the distance may not fit a long.
    """
    spark = vectors.sparkSession
    kept = vectors.where(whole(F.col("embedding")) & (F.size("embedding") == length)).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("vector"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = [r.vector for r in kept.select("vector", key.alias("key"), "vec_id").orderBy(F.col("key").asc_nulls_last(), "vector").limit(k).collect()]
    if not first:
        return spark.createDataFrame([], _SCHEMA)
    end = new_path(spark, "clusters")
    with temporary(spark):
        blocks = tree_blocks(kept, 1, length)
        (book,) = lloyd(blocks, [np.array(first, np.int64)], rounds)
        found = materialize(assignments(blocks, [book], "entry", "cluster int, distance long", ["vec_id"]), "clusters", end)
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    inertia = sum(sums.values())
    told = [(i, n, inertia, hashlib.sha256(",".join(map(str, book[i].tolist())).encode()).hexdigest()) for i, n in sums.items()]
    # as many rows as there are centroids
    told = F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return found.join(told, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
