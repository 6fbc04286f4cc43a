"""Vector code compression: a product quantiser whose codebooks are learnt by filtering Lloyd, in exact integers."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize, new_path, temporary
from .kdtree import assignments, integers, lloyd, tree_blocks, whole

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels whose sums are sent to all rows, at most; beyond, both are shuffled by label, a label's rows over many tasks.
BROADCAST_LABELS = 1 << 16
SALTS = 64


def code_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector of `vectors` (vec_id, embedding, label; others are ignored).

    Rows whose vector is null or holds null, NaN or an infinity aren't in the result. All vectors must have one length to be coded together: it is
    the commonest one that the parts divide (of equally common ones the longest), and vectors of other lengths, empty ones too, go as well. A codebook starts with
    the rows of the smallest vec_ids; rows of one vec_id are ordered by their vectors, and a null vec_id comes last. With fewer rows
    there are fewer entries, with none no rows. Null labels count as one label. A component of 2**27 or more after scaling is an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hexadecimal digits")
    spark, schema = vectors.sparkSession, "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    fit = vectors.where(whole(F.col("embedding")) & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    lengths = fit.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    length = lengths[0].length
    kept = fit.where(F.size("embedding") == length).select(F.col("vec_id").cast("long").alias("vec_id"), "label", integers(F.col("embedding"), scale).alias("vector"))
    first = np.array([r.vector for r in kept.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()], np.int64)
    end, width = new_path(spark, "codes"), length // parts
    with temporary(spark):
        blocks = tree_blocks(kept, parts, length)
        books = lloyd(blocks, [first[:, i * width : (i + 1) * width] for i in range(parts)], rounds)
        found = materialize(assignments(blocks, books, "code", "code string, error long", ["vec_id", "label"]), "codes", end)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    sums = found.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        told = found.alias("f").join(F.broadcast(sums.alias("s")), F.col("f.label").eqNullSafe(F.col("s.label")))
    else:
        salted = found.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        spread = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        told = salted.alias("f").join(spread.alias("s"), (F.col("f.salt") == F.col("s.salt")) & F.col("f.label").eqNullSafe(F.col("s.label")))
    return told.select("f.vec_id", "f.code", "f.error", "s.label_error", F.lit(digest).alias("codebooks_sha256"))
