"""Workflows as event logs: stages and gates, their state after all events, and what doesn't fit together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["ts", "event_id"]


def gate_states(events: DataFrame) -> DataFrame:
    """ws, stage, gate, since of a log (ws, stage, kind, ts, event_id): the last of open, approve and reject decides each gate.

    A gate that was opened and not decided is pending; a reset of the workspace to a stage takes back all decisions before it on this stage and later ones.
    """
    resets = events.where("kind = 'reset'").select("ws", F.col("stage").alias("from_stage"), F.struct(*ORDER).alias("reset_at"))
    own = events.where("kind IN ('open', 'approve', 'reject')").select("ws", "stage", F.struct(*ORDER).alias("at"), "kind")
    last = own.groupBy("ws", "stage").agg(F.max(F.struct("at", "kind")).alias("last"))
    # of a workspace's resets only the latest to each stage matters, so a stage meets as many as there are stages
    latest = resets.groupBy("ws", "from_stage").agg(F.max("reset_at").alias("reset_at"))
    undone = last.join(latest, "ws").where((F.col("from_stage") <= F.col("stage")) & (F.col("reset_at") > F.col("last.at"))).select("ws", "stage").distinct().withColumn("undone", F.lit(True))
    state = F.when(F.col("undone"), "pending").when(F.col("last.kind") == "approve", "approved").when(F.col("last.kind") == "reject", "rejected").otherwise("pending")
    return last.join(undone, ["ws", "stage"], "left").select("ws", "stage", state.alias("gate"), F.col("last.at.event_id").alias("since"))


def stage_blocks(gates: DataFrame) -> DataFrame:
    """ws, stage, blocked: whether the gate of any earlier stage is not approved."""
    by = Window.partitionBy("ws").orderBy("stage").rowsBetween(Window.unboundedPreceding, -1)
    return gates.select("ws", "stage", F.coalesce(F.max(F.col("gate") != "approved").over(by), F.lit(False)).alias("blocked"))


def invalidated(stages: DataFrame, resets: DataFrame) -> DataFrame:
    """ws, stage, status of stages (ws, stage, status): pending from the stage that a reset (ws, stage) names on."""
    first = resets.groupBy("ws").agg(F.min("stage").alias("from_stage"))
    status = F.when(F.col("stage") >= F.col("from_stage"), "pending").otherwise(F.col("status"))
    return stages.join(first, "ws", "left").select("ws", "stage", status.alias("status"))


def readiness(gates: DataFrame, inputs: DataFrame, done_stage: int) -> DataFrame:
    """ws, state: complete > missing_inputs > waiting_gate > blocked > ready. `inputs` has ws and present."""
    per = gates.groupBy("ws").agg(F.max((F.col("stage") >= done_stage) & (F.col("gate") == "approved")).alias("done"), F.max(F.col("gate") == "pending").alias("waits"), F.max(F.col("gate") == "rejected").alias("rejected"))
    missing = inputs.groupBy("ws").agg((F.count_if("present") == 0).alias("missing"))
    state = F.when(F.col("done"), "complete").when(F.coalesce("missing", F.lit(True)), "missing_inputs").when(F.col("waits"), "waiting_gate").when(F.col("rejected"), "blocked").otherwise("ready")
    return per.join(missing, "ws", "left").select("ws", state.alias("state"))


def lint(gates: DataFrame, receipts: DataFrame, outputs: DataFrame, events: DataFrame, known_stages: list[int], late_s: int = 600) -> DataFrame:
    """ws, code, severity, n: H1 approved gates without a receipt (ws, stage, hash of 64 hexadecimal digits), H2 outputs while a gate isn't approved, H3 outputs (ws, at) later than the last event by more than `late_s`, H4 stages that no graph knows, W3 logs whose last event lies a day before the last of all."""
    whole = receipts.where(F.col("hash").rlike("^[0-9a-f]{64}$")).select("ws", "stage").distinct()
    last = events.groupBy("ws").agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("last"))
    open_ = gates.where("gate <> 'approved'").select("ws").distinct()
    newest = last.agg(F.max("last").alias("newest"))
    rules = [
        ("H1", "HARD", gates.where("gate = 'approved'").join(whole, ["ws", "stage"], "left_anti")),
        ("H2", "HARD", outputs.join(open_, "ws", "left_semi")),
        ("H3", "HARD", outputs.join(last, "ws").where(F.col("at") > F.col("last") + late_s)),
        ("H4", "HARD", gates.where(~F.col("stage").isin(known_stages))),
        # one row, so it may go everywhere
        ("W3", "WARN", last.join(F.broadcast(newest), F.lit(True)).where(F.col("last") < F.col("newest") - 86_400)),
    ]
    found = None
    for code, severity, rows in rules:
        one = rows.select("ws", F.lit(code).alias("code"), F.lit(severity).alias("severity"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("ws", "code", "severity").agg(F.count(F.lit(1)).alias("n"))


def worst_codes(codes: DataFrame) -> DataFrame:
    """key, worst of exit codes (key, code): 3 over 2 over 0; a code that isn't known, or is null, counts as 3."""
    rank = F.when(F.col("code").isin(0, 2), F.col("code")).otherwise(3)
    return codes.groupBy("key").agg(F.max(rank).cast("int").alias("worst"))


def contradictions(verdicts: DataFrame) -> DataFrame:
    """The verdicts (key, converged, status) that have converged and are to be escalated all the same."""
    return verdicts.where(F.col("converged") & (F.lower(F.trim("status")) == "escalate_human"))


def proof_grade(evidence: Column, state: Column, quality: Column) -> Column:
    """The grade of a proof: every combination that isn't named is none."""
    good = F.coalesce(quality >= 0.5, F.lit(False))
    return F.when((evidence == "rendered") & (state == "accepted") & good, "A").when((evidence == "rendered") & (state == "accepted"), "B").when((evidence == "parsed") & (state == "accepted"), "C").otherwise("none")


def question_gate(turns: DataFrame, least: int = 12) -> DataFrame:
    """key, questions, asked, answered, ok of conversations (key, turn, role, text): a text of `least` letters or digits with a question mark is a question; ok if every message of a user is answered and one asks."""
    by = Window.partitionBy("key").orderBy("turn")
    own = turns.select("key", "turn", "role", (F.col("text").contains("?") & (F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")) >= least)).alias("asks"), (F.lead("role").over(by) == "assistant").alias("reply"))
    per = own.where("role = 'user'").groupBy("key").agg(F.count(F.lit(1)).alias("asked"), F.count_if("asks").alias("questions"), F.count_if("reply").alias("answered"))
    return per.select("key", "questions", "asked", "answered", ((F.col("questions") > 0) & (F.col("asked") == F.col("answered"))).alias("ok"))


def inventory(files: DataFrame, layout: DataFrame) -> DataFrame:
    """ws, stage, required, present, complete: what a layout (stage, name, needed) wants of each workspace, and what its files (ws, name) hold. Layouts are a declared vocabulary."""
    # of a workspace's files only names of the layout are kept, so it holds no more than these
    known = files.select("ws", "name").join(F.broadcast(layout.select("name", F.lit(True).alias("known")).distinct()), "name", "left")
    held = known.groupBy("ws").agg(F.collect_set(F.when(F.col("known") & F.col("ws").isNotNull(), F.col("name"))).alias("names"))
    stages = layout.groupBy("stage").agg(F.collect_list(F.struct("name", "needed")).alias("wanted"))
    there = lambda x: F.coalesce(F.array_contains("names", x["name"]), F.lit(False))
    size = lambda keep: F.size(F.filter("wanted", keep)).cast("long")
    lacking = F.exists("wanted", lambda x: F.coalesce(x["needed"], F.lit(False)) & ~there(x))
    return held.join(F.broadcast(stages), F.lit(True)).select("ws", "stage", size(lambda x: x["needed"]).alias("required"), size(there).alias("present"), (~lacking).alias("complete"))


def checksum_matches(references: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, state of referenced files (path, digest) against a manifest of the same: unlisted, mismatch or match, with paths told apart in any case and without a leading ./"""
    plain = lambda d: d.select(F.lower(F.regexp_replace("path", r"^(?:\./)+", "")).alias("path"), "digest")
    listed = plain(manifest).groupBy("path").agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
    fits = (F.col("digest") == F.col("least")) & (F.col("digest") == F.col("most"))
    return plain(references).distinct().join(listed, "path", "left").select("path", F.when(F.col("least").isNull(), "unlisted").when(fits, "match").otherwise("mismatch").alias("state"))
