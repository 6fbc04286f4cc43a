"""Records, receipts, checks and seats on small cases."""

import hashlib
import hmac
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.operators import evidence


def deflated(*records):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(b"".join(struct.pack("<I", tag | level << 10 | size << 20) + bytes(size) for tag, level, size in records)) + c.flush()


def test_records(spark):
    rows = [(1, deflated()), (2, deflated((66, 1, 0))), (3, deflated((66, 0, 3), (67, 1, 0))[:-2]), (4, None), (5, deflated((66, 0, 3), (67, 1, 0)) + b"")]
    got = evidence.record_scan(spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in rows], "k long, c binary"), "k", "c")
    assert {(r.k, r.seq, r.tag, r.size, r.fault) for r in got.collect()} == {(2, 0, 66, 0, "level_jump"), (3, 0, None, None, "deflate_invalid"), (4, 0, None, None, "deflate_invalid"), (5, 0, 66, 3, None), (5, 1, 67, 0, None)}


@pytest.mark.parametrize("key", [b"k", b"x" * 64, bytes(range(200))])
def test_keyed_digest(spark, key):
    texts = ["", "a", "가 é", None, "long " * 100]
    got = [r.d for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", evidence.keyed_digest(F.col("t"), key).alias("d")).orderBy("i").collect()]
    assert got == [None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts]


def test_masked_and_areas(spark):
    rows = [("ab\r\nc\rd", [(0.0, 0.0), (2.0, 0.0), (2.0, 3.0)]), ("x" * 61, [(1.0, 1.0)]), (None, None), ("", [])]
    df = spark.createDataFrame(rows, "t string, p array<struct<x: double, y: double>>")
    got = df.select(*[c.alias(n) for c, n in zip(evidence.masked(F.col("t")), ("d", "n", "s"))], evidence.polygon_area(F.col("p")).alias("a")).collect()
    assert [(r.n, r.s, r.a) for r in got] == [(7, "ab c d", 3.0), (61, "x" * 60 + "...", 0.0), (None, None, None), (0, "", 0.0)]


def test_checks_without_artifact(spark):
    checks = spark.createDataFrame([(1, "text_absent", "gone", "x"), (2, "text_absent", "a", "x"), (3, "text_absent", "a", None), (4, "odd", "a", "x"), (5, "file", "a", None)], "id long, kind string, name string, arg string")
    got = evidence.machine_checks(checks, spark.createDataFrame([("a", None)], "name string, text string")).collect()
    assert {(r.id, r.ok) for r in got} == {(1, False), (2, True), (3, False), (4, False), (5, True)}


def test_support_and_scorecards_of_nothing(spark):
    claims, pointers, targets = (spark.createDataFrame([], s) for s in ("claim long, status string", "claim long, target long", "target long"))
    assert evidence.support_matrix(claims, pointers, targets).count() == 0
    spaces = spark.createDataFrame([(1,)], "ws long")
    cards, files = (spark.createDataFrame([], s) for s in ("ws long, json string", "ws long, name string, digest string"))
    assert [tuple(r) for r in evidence.scorecard_faults(spaces, cards, files).collect()] == [(1, "scorecard_missing")]


def test_seats_of_others(spark):
    rows = [(1, 0, 0, None, 0.1, None), (1, 1, 0, "seal", 0.1, ["#000000"]), (1, 1, 1, "x", None, None), (1, None, 0, "rule", 0.1, []), (1, 2, 0, "□", 0.1, ["#f00"]), (1, 2, 0, "□", 0.1, ["#f00"])]
    cells = spark.createDataFrame(rows, "doc long, tab long, seat long, text string, brightness double, borders array<string>")
    assert sorted((r.tab, r.seat, r.basis) for r in evidence.staff_seats(cells, ["x"], "rule", 0.5).collect()) == [(0, 0, "shaded"), (1, 0, "shaded"), (1, 1, "label")]
    assert evidence.seal_slots(cells, ["seal"], ["#F00"]).count() == 0 and evidence.seal_slots(cells.where("tab = 0 or (tab = 1 and seat = 0)"), ["seal"], ["#F00"]).count() == 1
