"""Queries on record streams, receipts, checks, scorecards and seats, with the SQL that they equal."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..operators import evidence
from ..sources.tables import read_table
from . import documents_queries
from .documents_queries import _NOW, _TAB, SEALS

#: An open key, for the tables of invented orders only.
KEY = b"receipts of invented orders"
_PADS = [bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


def _stream(k: int) -> bytes:
    """Records by a number: some streams are cut, jump a level, have a long record, or aren't deflated."""
    if k % 11 == 5:
        return b"\xff\xff"
    n, parts = k % 6, []
    for i in range(n + 1):
        size = 5000 if k % 4 == 1 and i == 1 else 10 * i
        head = 66 + (k + i) % 5 | min(i, 2) << 10
        parts.append(struct.pack("<I", head | size << 20) if size < evidence.EXTENDED else struct.pack("<II", head | evidence.EXTENDED << 20, size))
        parts.append(bytes(size))
    data = b"".join(parts)
    if k % 9 == 0 and n:
        data = data[:-1]
    elif k % 7 == 3:
        data += struct.pack("<I", 70 | 9 << 10)
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    return deflate.compress(data) + deflate.flush()


def record_scan(spark, sf_dir):
    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"key": part.c_custkey, "content": [_stream(k) for k in part.c_custkey]})

    streams = read_table(spark, sf_dir, "customer").select("c_custkey").mapInPandas(build, "key long, content binary")
    return evidence.record_scan(streams, "key", "content")


def keyed_receipts(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", evidence.keyed_digest(F.concat_ws(":", "o_orderkey", "o_orderstatus"), KEY).alias("receipt"))


def masked_texts(spark, sf_dir):
    digest, length, start = evidence.masked(F.col("text"))
    return read_table(spark, sf_dir, "documents").select("doc_id", digest.alias("digest"), length.alias("chars"), start.alias("snippet"))


def polygon_areas(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("double").alias("y"))
    per = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("double").alias("x"), "y"))).alias("p"))
    return per.select("l_orderkey", evidence.polygon_area(F.col("p")).alias("area"))


_CHECK = "doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'file' WHEN 1 THEN 'text_present' WHEN 2 THEN 'text_absent' WHEN 3 THEN 'unmodified' ELSE 'other' END AS kind, CASE WHEN doc_id % 7 = 6 THEN 'd' ELSE concat('d', CAST(doc_id AS {string})) END AS name"


def machine_checks(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    arg = F.when(F.col("doc_id") % 5 == 3, F.sha2(F.encode(F.when(F.col("doc_id") % 2 == 0, F.coalesce("text", F.lit(""))).otherwise("x"), "UTF-8"), 256)).otherwise("the")
    checks = docs.select(*map(F.expr, documents_queries._columns(_CHECK.format(string="string"))), arg.alias("arg"))
    return evidence.machine_checks(checks, docs.select(F.concat(F.lit("d"), "doc_id").alias("name"), "text"))


_CARD = "CASE c_custkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN '{\"stop_lines\": []}' WHEN 2 THEN '{\"stop_lines\": {}}' WHEN 3 THEN '{\"stop_lines\": {\"a\": 1}, \"sheet\": {\"path\": \"p0\", \"sha256\": \"F\"}}' ELSE concat('{\"sheet\": {\"path\": \"p', CAST(c_custkey % 10 AS {string}), '\", \"sha256\": \"O\"}}') END"


def scorecard_faults(spark, sf_dir):
    people = read_table(spark, sf_dir, "customer")
    cards = people.where("c_custkey % 13 <> 1").selectExpr("c_custkey AS ws", f"{_CARD.replace('{string}', 'string')} AS json")
    files = read_table(spark, sf_dir, "orders").selectExpr("o_custkey AS ws", "concat('p', o_orderkey % 10) AS name", "o_orderstatus AS digest")
    return evidence.scorecard_faults(people.selectExpr("c_custkey AS ws"), cards, files.groupBy("ws", "name").agg(F.min("digest").alias("digest")))


def support_matrix(spark, sf_dir):
    claims = read_table(spark, sf_dir, "orders").selectExpr("o_orderkey AS claim", "o_orderstatus AS status")
    pointers = read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS claim", "l_partkey AS target")
    return evidence.support_matrix(claims, pointers, read_table(spark, sf_dir, "part").where("p_size < 10").selectExpr("p_partkey AS target"))


def _cells(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").selectExpr("conv_id AS doc", f"CAST({_TAB} AS long) AS tab", "CAST(turn AS long) AS seat", f"{_NOW} AS text", "CAST(turn % 10 AS double) / 10 AS brightness", "CASE WHEN turn % 4 = 0 THEN array('#ff0000') ELSE array('#000000') END AS borders")


def staff_seats(spark, sf_dir):
    return evidence.staff_seats(_cells(spark, sf_dir), ["Labour Act", "owner"], "[Form 7]", 0.6)


def seal_slots(spark, sf_dir):
    return evidence.seal_slots(_cells(spark, sf_dir), SEALS, ["#FF0000"])


def package_seats(spark, sf_dir):
    return evidence.seats(documents_queries.package_blocks(spark, sf_dir), "page_id")


QUERIES = {
    "record_scan": record_scan,
    "keyed_receipts": keyed_receipts,
    "masked_texts": masked_texts,
    "polygon_areas": polygon_areas,
    "machine_checks": machine_checks,
    "scorecard_faults": scorecard_faults,
    "support_matrix": support_matrix,
    "staff_seats": staff_seats,
    "seal_slots": seal_slots,
    "package_seats": package_seats,
}

_C = f"c AS (SELECT conv_id AS doc, {_TAB} AS tab, turn AS seat, {_NOW} AS text, turn, regexp_replace({_NOW}, '\\s', '', 'g') AS s FROM conversations)"

ORACLE_SQL = {
    "record_scan": """WITH r AS (SELECT c_custkey AS key, CAST(i AS BIGINT) AS seq, 66 + (c_custkey + i) % 5 AS tag, least(i, 2) AS level, CASE WHEN c_custkey % 4 = 1 AND i = 1 THEN 5000 ELSE 10 * i END AS size, CASE WHEN c_custkey % 9 = 0 AND i > 0 AND i = c_custkey % 6 THEN 'payload_truncated' END AS fault FROM customer, range(6) AS t(i) WHERE i <= c_custkey % 6 AND c_custkey % 11 <> 5)
        SELECT * FROM r UNION ALL SELECT c_custkey, c_custkey % 6 + 1, 70, 9, 0, 'level_jump' FROM customer WHERE c_custkey % 7 = 3 AND c_custkey % 11 <> 5 AND NOT (c_custkey % 9 = 0 AND c_custkey % 6 > 0) UNION ALL SELECT c_custkey, 0, NULL, NULL, NULL, 'deflate_invalid' FROM customer WHERE c_custkey % 11 = 5""",
    "keyed_receipts": f"SELECT o_orderkey, sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || encode(o_orderkey || ':' || o_orderstatus)))) AS receipt FROM orders",
    "masked_texts": "WITH d AS (SELECT *, regexp_replace(text, '\\r\\n|[\\r\\n]', ' ', 'g') AS f FROM documents) SELECT doc_id, sha256(text) AS digest, CAST(length(text) AS BIGINT) AS chars, CASE WHEN length(f) > 60 THEN substr(f, 1, 60) || '...' ELSE f END AS snippet FROM d",
    "polygon_areas": """WITH p AS (SELECT l_orderkey, l_linenumber AS x, CAST(max(l_quantity) AS DOUBLE) AS y FROM lineitem GROUP BY 1, 2), n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS u, coalesce(lead(y) OVER w, first_value(y) OVER w) AS v FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY x))
        SELECT l_orderkey, CASE WHEN count(*) < 3 THEN 0 ELSE abs(sum(x * v - u * y)) / 2 END AS area FROM n GROUP BY 1""",
    "machine_checks": f"""WITH c AS (SELECT *, doc_id % 7 <> 6 AS there FROM (SELECT {_CHECK.format(string='VARCHAR')}, doc_id, coalesce(text, '') AS t FROM documents))
        SELECT id, kind, there AND CASE kind WHEN 'file' THEN true WHEN 'text_present' THEN contains(t, 'the') WHEN 'text_absent' THEN NOT contains(t, 'the') WHEN 'unmodified' THEN id % 2 = 0 OR t = 'x' ELSE false END AS ok FROM c""",
    "scorecard_faults": """WITH f AS (SELECT o_custkey AS ws, o_orderkey % 10 AS p, min(o_orderstatus) AS d FROM orders GROUP BY 1, 2), c AS (SELECT c_custkey AS ws, CASE WHEN c_custkey % 13 = 1 OR c_custkey % 6 = 0 THEN 0 ELSE c_custkey % 6 END AS k, CASE WHEN c_custkey % 6 = 3 THEN 0 ELSE c_custkey % 10 END AS p, CASE WHEN c_custkey % 6 = 3 THEN 'F' ELSE 'O' END AS pin FROM customer), j AS (SELECT c.*, f.d FROM c LEFT JOIN f ON f.ws = c.ws AND f.p = c.p)
        SELECT ws, 'scorecard_missing' AS code FROM j WHERE k = 0 UNION ALL SELECT ws, 'stop_lines_invalid' FROM j WHERE k IN (1, 4, 5) UNION ALL SELECT ws, 'sheet_missing' FROM j WHERE k >= 3 AND d IS NULL UNION ALL SELECT ws, 'sheet_changed' FROM j WHERE k >= 3 AND d <> pin""",
    "support_matrix": "SELECT o_orderstatus AS status, count(*) AS claims, count(*) FILTER (NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND p_size < 10)) AS unsupported FROM orders GROUP BY 1",
    "staff_seats": f"WITH {_C}, x AS (SELECT doc, tab, seat, concat_ws(',', CASE WHEN contains(s, 'LabourAct') OR contains(s, 'owner') THEN 'label' END, CASE WHEN doc IN (SELECT doc FROM c WHERE contains(text, '[Form 7]')) AND turn % 10 <= 6 AND NOT regexp_matches(text, '[■☑●□☐]') THEN 'shaded' END) AS basis FROM c WHERE tab IS NOT NULL) SELECT * FROM x WHERE basis <> ''",
    "seal_slots": f"WITH {_C}, x AS (SELECT doc, tab, min(seat) AS seat, bool_or(turn % 4 = 0) AS red, bool_or(contains(s, 'seal')) AS labelled FROM c WHERE tab IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1) SELECT * FROM x WHERE red OR labelled",
    "package_seats": f"WITH b AS ({documents_queries.ORACLE_SQL['package_blocks']}), n AS (SELECT *, CASE WHEN member LIKE '%1.xml' THEN 1000000 ELSE 0 END AS s FROM b WHERE kind IN ('cell', 'paragraph')) SELECT page_id AS doc, s + tab AS tab, s + seq AS seat, text FROM n",
}
