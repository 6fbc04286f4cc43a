"""The same rules on streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, per_trigger: int = 16) -> DataFrame:
    """Events of a growing folder of Parquet files; the query's checkpoint remembers which were read."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts in windows of an hour; rows later than the watermark are dropped, and each window comes once."""
    per = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return per.select(F.col("w.start").alias("starts"), "event_type", "n")


def latest_state(events: DataFrame) -> DataFrame:
    """The newest event of each user (update mode); ties in time go to the larger id."""
    newest = events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id")).alias("e"))
    return newest.select("user_id", "e.event_id", "e.event_type", "e.ts")


def json_lines(spark: SparkSession, path: str, schema: str, per_trigger: int = 16) -> DataFrame:
    """Events of a growing folder of files of JSON lines; a line that doesn't fit the schema gives nulls."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def without_repeats(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event_id once, as far as its repeats come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
