"""Places in texts as rows with start and end, and the join of places that lie near each other."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places that a bucket of the band join covers.
BUCKET = 256
#: Spans that leave a task in one batch.
BATCH_SPANS = 1 << 14


def spans(rows: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """The other columns of `rows`, then kind, start, end (characters from 0, the end is excluded), found: each match of each pattern in its text. A null text has none."""
    compiled = {kind: re.compile(p) for kind, p in patterns.items()}
    kept = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, kinds, places = [], [], []

            def made(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                at = pa.array(own, pa.int64())
                columns = [*(batch.column(c).take(at) for c in kept), pa.array(kinds, pa.string()), *(pa.array([p[i] for p in places], pa.int64() if i < 2 else pa.string()) for i in range(3))]
                return pa.RecordBatch.from_arrays(columns, names=[*kept, "kind", "start", "end", "found"])

            for i, x in enumerate(batch.column(text).to_pylist()):
                for kind, pattern in compiled.items():
                    for m in pattern.finditer(x or ""):
                        own.append(i)
                        kinds.append(kind)
                        places.append((m.start(), m.end(), m.group()))
                if len(own) >= BATCH_SPANS:
                    yield made()
                    own, kinds, places = [], [], []
            if own:
                yield made()

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "kind string, start long, end long, found string"])
    return rows.select(*kept, text).mapInArrow(run, schema)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], gap: int, width: int = BUCKET) -> DataFrame:
    """The pairs of spans (start, end and other columns) with equal keys and at most `gap` places between: the keys, the left columns as a_*, the right ones as b_*, and the gap (0 if they touch or overlap).

    Spans meet in buckets of `width` places: the left ones, widened by the gap, in each bucket that they reach, the right ones in each that they
    cover. A pair is taken in the first bucket that both have, so it comes once, and no key gathers more than a bucket in one place.
    """
    named = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys])
    bucket = lambda c: F.floor(c / width).cast("long")
    a, b = named(left, "a"), named(right, "b")
    a = a.withColumn("a_bucket", bucket(F.col("a_start") - gap)).withColumn("bucket", F.explode(F.sequence("a_bucket", bucket(F.col("a_end") + gap))))
    b = b.withColumn("b_bucket", bucket(F.col("b_start"))).withColumn("bucket", F.explode(F.sequence("b_bucket", bucket(F.col("b_end")))))
    between = F.greatest(F.col("b_start") - F.col("a_end"), F.col("a_start") - F.col("b_end"), F.lit(0))
    met = a.join(b, [*keys, "bucket"]).where(F.col("bucket") == F.greatest("a_bucket", "b_bucket")).withColumn("gap", between)
    return met.where(F.col("gap") <= gap).drop("bucket", "a_bucket", "b_bucket")
