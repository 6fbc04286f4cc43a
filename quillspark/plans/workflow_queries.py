"""Queries on stages, gates and logs, with the SQL that they equal. A user's events are the log of a workspace; the stage follows from the value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import workflow
from ..sources.tables import read_table, table_path
from ..streaming import gates
from .fixtures import literal, values
from .shared import dealt

_KIND = "CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'reset' ELSE 'open' END"
_COLUMNS = ["user_id AS ws", "CAST(floor(value) AS BIGINT) % 6 AS stage", f"{_KIND} AS kind", "ts", "event_id"]
_LOG = ", ".join(_COLUMNS)
STAGES = [0, 1, 2, 3, 4]
LAYOUT = [(1, "0", True), (1, "1", False), (2, "2", True), (2, "3", True), (3, "4", False)]


def _log(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "events").selectExpr(*_COLUMNS)


def _gates(spark, sf_dir) -> DataFrame:
    return workflow.gate_states(_log(spark, sf_dir))


def gate_stream(spark, sf_dir):
    """The log as a stream, a gate's state kept from batch to batch; equal to the replay of the whole log."""
    path = table_path(sf_dir, "events")
    # a pattern is taken for a file as well as for a folder
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.replace("events.parquet", "event[s].parquet")).selectExpr(*_COLUMNS)
    return gates.final_states(spark, events)


def invalidated(spark, sf_dir):
    log = _log(spark, sf_dir)
    stages = log.groupBy("ws", "stage").agg(F.max("kind").alias("status"))
    return workflow.invalidated(stages, log.where("kind = 'reset'").select("ws", "stage"))


def readiness(spark, sf_dir):
    inputs = read_table(spark, sf_dir, "events").selectExpr("user_id AS ws", "value > 100 AS present")
    return workflow.readiness(_gates(spark, sf_dir), inputs, 5)


def lint(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    receipts = events.select(F.col("user_id").alias("ws"), F.col("event_id") % 6, F.sha2(F.col("event_id").cast("string"), 256).alias("hash"), "event_id").toDF("ws", "stage", "hash", "event_id")
    receipts = receipts.select("ws", "stage", F.when(F.col("event_id") % 3 == 0, F.substring("hash", 1, 40)).otherwise(F.col("hash")).alias("hash"))
    outputs = events.where("event_type = 'view'").select(F.col("user_id").alias("ws"), (F.unix_seconds(F.col("ts").cast("timestamp")) + (F.col("event_id") % 5) * 300).alias("at"))
    return workflow.lint(_gates(spark, sf_dir), receipts, outputs, _log(spark, sf_dir), STAGES)


def worst_codes(spark, sf_dir):
    return workflow.worst_codes(read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS key", "CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_returnflag = 'A' THEN 2 WHEN l_quantity > 40 THEN NULL ELSE 0 END AS code"))


def contradictions(spark, sf_dir):
    return workflow.contradictions(read_table(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", "o_totalprice > 100000 AS converged", "CASE WHEN o_orderstatus = 'F' THEN ' Escalate_Human ' ELSE o_orderstatus END AS status"))


def proof_grades(spark, sf_dir):
    grade = workflow.proof_grade(F.expr("CASE WHEN p_size % 3 = 0 THEN 'rendered' WHEN p_size % 3 = 1 THEN 'parsed' ELSE 'told' END"), F.expr("CASE WHEN p_partkey % 4 = 0 THEN 'failed' ELSE 'accepted' END"), F.expr("CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size / 50D END"))
    return read_table(spark, sf_dir, "part").select(grade.alias("grade")).groupBy("grade").agg(F.count(F.lit(1)).alias("proofs"))


def question_gate(spark, sf_dir):
    return workflow.question_gate(read_table(spark, sf_dir, "conversations").selectExpr("conv_id AS key", "turn", "role", "CASE WHEN turn % 4 = 0 THEN concat(text, '?') ELSE text END AS text"))


def inventory(spark, sf_dir):
    files = dealt(read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS ws", "CAST(l_linenumber % 5 AS string) AS name"), "ws")
    return workflow.inventory(files, spark.createDataFrame(LAYOUT, "stage long, name string, needed boolean"))


def checksum_matches(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", F.sha2("html", 256).alias("digest"))
    references = pages.select(F.concat(F.lit("./"), F.upper("url")).alias("path"), "digest").unionByName(pages.where("page_id % 7 = 0").select(F.concat("url", F.lit("x")).alias("path"), "digest"))
    return workflow.checksum_matches(references, pages.select(F.col("url").alias("path"), F.when(F.col("page_id") % 5 == 0, F.reverse("digest")).otherwise(F.col("digest")).alias("digest")))


QUERIES = {
    "gate_states": _gates,
    "gate_stream": gate_stream,
    "stage_blocks": lambda spark, sf_dir: workflow.stage_blocks(_gates(spark, sf_dir)),
    "invalidated": invalidated,
    "readiness": readiness,
    "workflow_lint": lint,
    "worst_codes": worst_codes,
    "contradictions": contradictions,
    "proof_grades": proof_grades,
    "question_gate": question_gate,
    "inventory": inventory,
    "checksum_matches": checksum_matches,
}

_GATES = f"""e AS (SELECT {_LOG} FROM events), r AS (SELECT ws, stage AS s0, (ts, event_id) AS at FROM e WHERE kind = 'reset'), x AS (SELECT ws, stage, kind, (ts, event_id) AS place, event_id FROM e WHERE kind <> 'reset'),
    n AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY ws, stage ORDER BY place DESC) = 1),
    g AS (SELECT ws, stage, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.ws = n.ws AND r.s0 <= n.stage AND r.at > n.place) THEN 'pending' WHEN kind = 'approve' THEN 'approved' WHEN kind = 'reject' THEN 'rejected' ELSE 'pending' END AS gate, event_id AS since FROM n)""".replace(" AS at FROM e", " AS at_ FROM e").replace("r.at > n.place", "r.at_ > n.place")

ORACLE_SQL = {
    "gate_states": f"WITH {_GATES} SELECT * FROM g",
    "gate_stream": f"WITH {_GATES} SELECT * FROM g",
    "stage_blocks": f"WITH {_GATES} SELECT ws, stage, coalesce(bool_or(gate <> 'approved') OVER (PARTITION BY ws ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS blocked FROM g",
    "invalidated": f"WITH {_GATES}, s AS (SELECT ws, stage, max(kind) AS status FROM e GROUP BY 1, 2), f AS (SELECT ws, min(s0) AS f FROM r GROUP BY 1) SELECT ws, stage, CASE WHEN stage >= f THEN 'pending' ELSE status END AS status FROM s LEFT JOIN f USING (ws)",
    "readiness": f"""WITH {_GATES}, m AS (SELECT user_id AS ws, count(*) FILTER (value > 100) = 0 AS missing FROM events GROUP BY 1)
        SELECT ws, CASE WHEN bool_or(stage >= 5 AND gate = 'approved') THEN 'complete' WHEN any_value(missing) THEN 'missing_inputs' WHEN bool_or(gate = 'pending') THEN 'waiting_gate' WHEN bool_or(gate = 'rejected') THEN 'blocked' ELSE 'ready' END AS state FROM g JOIN m USING (ws) GROUP BY 1""",
    "workflow_lint": f"""WITH {_GATES}, o AS (SELECT user_id AS ws, CAST(floor(epoch(ts)) AS BIGINT) + (event_id % 5) * 300 AS at_ FROM events WHERE event_type = 'view'), t AS (SELECT ws, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last FROM e GROUP BY 1),
        c AS (SELECT DISTINCT user_id AS ws, event_id % 6 AS stage FROM events WHERE event_id % 3 <> 0),
        f AS (SELECT ws, 'H1' AS code, 'HARD' AS severity FROM g WHERE gate = 'approved' AND NOT EXISTS (SELECT 1 FROM c WHERE c.ws = g.ws AND c.stage = g.stage)
              UNION ALL SELECT ws, 'H2', 'HARD' FROM o WHERE ws IN (SELECT ws FROM g WHERE gate <> 'approved') UNION ALL SELECT ws, 'H3', 'HARD' FROM o JOIN t USING (ws) WHERE at_ > last + 600
              UNION ALL SELECT ws, 'H4', 'HARD' FROM g WHERE stage NOT IN ({', '.join(map(literal, STAGES))}) UNION ALL SELECT ws, 'W3', 'WARN' FROM t WHERE last < (SELECT max(last) FROM t) - 86400)
        SELECT ws, code, severity, count(*) AS n FROM f GROUP BY 1, 2, 3""",
    "worst_codes": "SELECT l_orderkey AS key, CAST(max(CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_returnflag = 'A' THEN 2 WHEN l_quantity > 40 THEN 3 ELSE 0 END) AS INTEGER) AS worst FROM lineitem GROUP BY 1",
    "contradictions": "SELECT o_orderkey AS key, true AS converged, ' Escalate_Human ' AS status FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'",
    "proof_grades": """SELECT CASE WHEN p_partkey % 4 = 0 OR p_size % 3 = 2 THEN 'none' WHEN p_size % 3 = 1 THEN 'C' WHEN p_partkey % 7 <> 0 AND p_size / 50.0::DOUBLE >= 0.5 THEN 'A' ELSE 'B' END AS grade, count(*) AS proofs FROM part GROUP BY 1""",
    "question_gate": """WITH k AS (SELECT conv_id AS key, role, CASE WHEN turn % 4 = 0 THEN text || '?' ELSE text END AS t, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations),
        q AS (SELECT key, count(*) FILTER (contains(t, '?') AND length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) >= 12) AS questions, count(*) AS asked, count(*) FILTER (next = 'assistant') AS answered FROM k WHERE role = 'user' GROUP BY 1) SELECT *, questions > 0 AND asked = answered AS ok FROM q""",
    "inventory": f"""WITH f AS (SELECT DISTINCT l_orderkey AS ws, CAST(l_linenumber % 5 AS VARCHAR) AS name FROM lineitem), y AS {values([(a, b, int(c)) for a, b, c in LAYOUT], 'stage, name, needed')}, w AS (SELECT * FROM (SELECT DISTINCT ws FROM f), y)
        SELECT w.ws, CAST(stage AS BIGINT) AS stage, count(*) FILTER (needed = 1) AS required, count(f.name) AS present, count(*) FILTER (needed = 1 AND f.name IS NULL) = 0 AS complete FROM w LEFT JOIN f ON f.ws = w.ws AND f.name = w.name GROUP BY 1, 2""",
    "checksum_matches": """WITH p AS (SELECT page_id, url, sha256(html) AS d FROM pages), r AS (SELECT DISTINCT lower(url) AS path, d FROM p UNION SELECT lower(url || 'x'), d FROM p WHERE page_id % 7 = 0), m AS (SELECT lower(url) AS path, CASE WHEN page_id % 5 = 0 THEN reverse(d) ELSE d END AS d FROM p),
        l AS (SELECT path, min(d) AS a, max(d) AS b FROM m GROUP BY 1) SELECT path, CASE WHEN a IS NULL THEN 'unlisted' WHEN d = a AND d = b THEN 'match' ELSE 'mismatch' END AS state FROM r LEFT JOIN l USING (path)""",
}
