"""Ordered rows: state folds, sessions, gates and the latest of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def restarts(events: DataFrame) -> DataFrame:
    """user_id, sessions: a new one where the value doesn't rise."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fall = (F.col("value") <= F.lag("value").over(w)).cast("int")
    return events.select("user_id", F.coalesce(fall, F.lit(0)).alias("new")).groupBy("user_id").agg((F.sum("new") + 1).alias("sessions"))


def forward_fill(turns: DataFrame) -> DataFrame:
    """conv_id, turn, asked_in: the turn of the last user message at or before each turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(w).alias("asked_in"))


def answered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, answer_chars: user messages with the length of the reply that follows at once."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    reply = F.when(F.lead("role").over(w) == "assistant", F.length(F.lead("text").over(w)))
    return turns.select("conv_id", "turn", "role", reply.alias("answer_chars")).where("role = 'user'").select("conv_id", "turn", "answer_chars")


def latest(events: DataFrame, keep: int = 2) -> DataFrame:
    """user_id, rank, event_id, event_type: the newest `keep` events of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).select("user_id", "rank", "event_id", "event_type")


def blocked(events: DataFrame) -> DataFrame:
    """event_id, blocked: whether an earlier event of the user was an error."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events.select("event_id", F.coalesce(F.max(F.col("event_type") == "error").over(w), F.lit(False)).alias("blocked"))


def windows(events: DataFrame) -> DataFrame:
    """starts, event_type, n, total in windows of an hour."""
    per = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return per.select(F.col("w.start").alias("starts"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, starts, n: sessions that end after a gap without events."""
    per = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("user_id", F.col("w.start").alias("starts"), "n")


def property_path(events: DataFrame, path: str = "$.k") -> DataFrame:
    """event_type, n, least, most, missing of a JSON property."""
    value = F.get_json_object("props", path).try_cast("long")
    return events.select("event_type", value.alias("v")).groupBy("event_type").agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.count_if(F.col("v").isNull()).alias("missing"))


def stale(events: DataFrame, seconds: int = 86_400) -> DataFrame:
    """user_id, silent_s: users whose last event lies more than `seconds` before the last of all."""
    last = events.groupBy("user_id").agg(F.max("ts").alias("ts"))
    newest = last.agg(F.max("ts").alias("newest"))
    silent = (F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1_000_000
    # one row, so it may go everywhere
    return last.join(F.broadcast(newest), F.lit(True)).select("user_id", F.floor(silent).cast("long").alias("silent_s")).where(F.col("silent_s") > seconds)


def in_effect(events: DataFrame, kind: str) -> DataFrame:
    """event_id, last_id: the user's last event of a kind at or before each event (an as-of join)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("event_id", F.last(F.when(F.col("event_type") == kind, F.col("event_id")), True).over(w).alias("last_id"))


def occurrence_ids(events: DataFrame) -> DataFrame:
    """event_id, ordinal, claim_id: a stable id from the signature and which occurrence of it this is."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = events.withColumn("ordinal", F.row_number().over(w))
    return rows.select("event_id", "ordinal", F.sha2(F.concat_ws("|", "user_id", "event_type", "ordinal"), 256).alias("claim_id"))
