"""Places in texts, the band join, and the privacy rules that stand on them, against brute force."""

import hashlib
import random
import re

from quillspark.operators import privacy, spans

PATTERNS = {"number": privacy.NUMBER, "name": privacy.NAME}


def gap(a, b):
    return max(b[0] - a[1], a[0] - b[1], 0)


def test_band_join_equals_brute_force(spark):
    rng = random.Random(3)
    rows = {"l": [], "r": []}
    for side in rows:
        for i in range(300):
            start = rng.randrange(2000)
            rows[side].append((rng.randrange(2), start, start + rng.choice([0, 1, 5, 40, 300]), i))
    frames = [spark.createDataFrame(rows[s], "key long, start long, end long, id long") for s in "lr"]
    for width in (8, 100, 5000):
        got = sorted((r.a_id, r.b_id, r.gap) for r in spans.band_join(*frames, ["key"], 12, width).collect())
        assert got == sorted((a[3], b[3], gap(a[1:3], b[1:3])) for a in rows["l"] for b in rows["r"] if a[0] == b[0] and gap(a[1:3], b[1:3]) <= 12)
    assert spans.band_join(frames[0].limit(0), frames[1], ["key"], 12).count() == 0


def test_spans_carry_other_columns(spark):
    df = spark.createDataFrame([(1, "12345 김철수", "x"), (None, None, "y"), (3, "", None)], "doc_id long, text string, found2 string")
    got = spans.spans(df, PATTERNS).collect()
    assert [tuple(r) for r in got] == [(1, "x", "number", 0, 5, "12345"), (1, "x", "name", 6, 9, "김철수")]


PROBED = [
    (1, "가나다라마바사 123456789\n12345 가나"),
    (1, "나라 12345\n12345 가나"),  # the same id: rows are kept apart
    (2, "12345 김철수 23456 (이영희) 34567 " * 400),  # one hot line of many buckets
    (3, "가나" + " " * 12 + "12345" + " " * 13 + "다라"),
    (4, None),
]


def test_named_numbers_equal_brute_force(spark):
    df = spark.createDataFrame(PROBED, "doc_id long, text string")
    want = []
    for doc, text in PROBED:
        for n, line in enumerate((text or "").split("\n"), 1):
            for a in re.finditer(privacy.NUMBER, line):
                for b in re.finditer(privacy.NAME, line):
                    if gap(a.span(), b.span()) <= 12:
                        start, end = min(a.start(), b.start()), max(a.end(), b.end())
                        want.append((doc, n, start, line[start : min(end, start + 60)]))
    assert sorted(map(tuple, privacy.named_numbers(df).collect())) == sorted(want) and len(want) > 1000


def test_identity_numbers_side_by_side_and_with_blanks(spark):
    df = spark.createDataFrame([(1, "900101-1234567 900102-1234567"), (2, "900101 - 1234567"), (3, "1900101-1234567, 900101-12345678, 900101-5234567"), (4, "010 - 1234 -5678,01012345678 010-12-3456 x010-123-4567y")], "doc_id long, text string")
    digest = lambda n: hashlib.sha256(n.encode()).hexdigest()
    want = [(1, "resident", digest("9001011234567")), (1, "resident", digest("9001021234567")), (2, "resident", digest("9001011234567")), (4, "phone", digest("01012345678")), (4, "phone", digest("0101234567"))]
    assert sorted((r.doc_id, r.kind, r.number) for r in privacy.identity_numbers(df).collect()) == sorted(want)
    assert {r.doc_id: (r.hard, r.warn, r.exit_code) for r in privacy.gate(df, []).collect()} == {1: (2, 0, 3), 2: (1, 0, 3), 3: (0, 0, 0), 4: (2, 0, 3)}


def test_near_numbers_count_every_neighbouring_pair(spark):
    df = spark.createDataFrame([(1, "12345 23456 345678\n1234 12345"), (2, "12345" + "x" * 13 + "12345")], "doc_id long, text string")
    assert [tuple(r) for r in privacy.near_numbers(df).collect()] == [(1, 1, 2)]
