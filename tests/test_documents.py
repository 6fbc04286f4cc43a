"""Files, packages, inventories and measured pages on small cases: what is broken, null, empty, repeated or absent."""

import pyarrow as pa
import pytest

from quillspark.operators import inventories, layout
from quillspark.sources import files

SEATS = "doc long, tab long, seat long, text string"
LINES = "doc long, page long, y0 double, y1 double, size double, text string"
BOXES = "doc long, page long, kind string, x0 double, x1 double, y0 double, y1 double"


def test_walk_prunes_folders(spark, tmp_path):
    for name in ("a.txt", "in/b.txt", ".git/c", "in/node_modules/d/e.txt", "node_modules.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    got = {r.path: (r.length, bytes(r.content)) for r in files.files(spark, f"file://{tmp_path}").collect()}
    assert got == {n: (len(n), n.encode()) for n in ("a.txt", "in/b.txt", "node_modules.txt")}
    assert {r.path for r in files.files(spark, str(tmp_path)).select("path").collect()} == set(got)


def test_codecs(spark):
    rows = [(1, bytearray("가".encode("cp949"))), (1, bytearray("가".encode())), (2, bytearray(b"\xff\xff")), (3, None), (4, bytearray())]
    got = [(r.id, r.text, r.codec) for r in files.decoded(spark.createDataFrame(rows, "id long, content binary")).collect()]
    assert got == [(1, "가", "cp949"), (1, "가", "utf-8"), (2, None, None), (3, None, None), (4, "", "utf-8")]


def test_json_lines_from_an_offset(spark):
    log = '{"a": 1}\n\n[1]\nbroken\r\n{"a": "x"}\n{"a": 5, "b": 2}\n7'
    got = files.json_lines(spark.createDataFrame([("k", log), ("n", None), ("e", "")], "key string, log string"), "key", "log", "a LONG", 1)
    assert [(r.key, r.line, r.value.a) for r in got.collect()] == [("k", 5, 5)]


def test_packages_that_are_none(spark):
    rows = [(1, None), (2, bytearray()), (3, bytearray(b"PK\x03\x04 cut"))]
    found = files.members(spark.createDataFrame(rows, "id long, content binary"), "id")
    assert sorted((r.id, r.member, r.fault) for r in found.collect()) == [(i, None, "no archive") for i in (1, 2, 3)]
    assert files.sections(found, "id").count() == 0 and files.blocks(found, "id").count() == 0


def test_seats_without_text(spark):
    seats = spark.createDataFrame([(1, None, 0, None), (1, 1, 0, ""), (1, 1, 0, ""), (None, 1, 0, "(□ yes □ no) consent")], SEATS)
    assert inventories.checkbox_cells(seats).count() == 1
    for operator, more in ((inventories.signature_cells, ()), (inventories.seal_cells, (["seal"],)), (inventories.statute_counts, (["law"],)), (inventories.stencil_fragments, ()), (inventories.party_values, (["owner"],)), (inventories.consent_groups, (["consent"], ["yes"], ["must"])), (inventories.measures, (["Dear"], "notes"))):
        operator(seats, *more).collect()
        assert operator(seats.limit(0), *more).count() == 0


def test_consent_is_read_from_the_table(spark):
    rows = [(1, 5, 0, "consent to all"), (1, 5, 1, "( ■ agree  □ not )"), (1, 5, 2, "(yes/ no)"), (1, 5, 3, "(yes)"), (1, None, 4, "(yes, no)"), (2, 5, 0, "(yes, no)")]
    got = inventories.consent_groups(spark.createDataFrame(rows, SEATS), ["consent"], ["yes", "no"], ["must"]).collect()
    assert sorted((r.doc, r.seat, r.options, r.basis, r.marked) for r in got) == [(1, 1, 2, "glyphs", 1), (1, 2, 2, "tokens", 0)]


def test_longer_labels_win(spark):
    seats = spark.createDataFrame([(1, 0, 0, "name of firm : ACME name : (sign) ___")], SEATS)
    got = [(r.position, r.label, r.value) for r in inventories.party_values(seats, ["name", "name of firm"]).orderBy("position").collect()]
    assert got == [(0, "nameoffirm", "ACME"), (1, "name", "")]


@pytest.mark.parametrize(("text", "state", "severity"), [("fill ____ here", None, None), ("filled ____", "draft", "WARN"), ("filled ____ 2024-01-02", "final", "HARD")])
def test_gate_by_state(spark, text, state, severity):
    seats, blank = (spark.createDataFrame([(1, 0, 0, t)], SEATS) for t in (text, "fill ____ here"))
    now, was = (inventories.measures(x, ["Dear"], "notes") for x in (seats, blank))
    found = inventories.gate(now, was, inventories.states(now, inventories.written_seats(seats, blank, False)), inventories.GRANT).collect()
    assert [(r.state, r.code, r.severity, r.n) for r in found] == ([] if state is None else [(state, "residue_left", severity, 1)])


def test_gate_compares_with_the_blank_form(spark):
    blank = spark.createDataFrame([(1, 0, 0, "[Form 1] Dear □ 제 3 조 (sign)")], SEATS)
    now, was = (inventories.measures(x, ["Dear"], "notes") for x in (spark.createDataFrame([(1, 0, 0, "제4조 x"), (2, 0, 0, "x")], SEATS), blank))
    states = inventories.states(now, inventories.written_seats(blank, blank, True))
    both = inventories.gate(now, was, states, inventories.STAFF + inventories.PETITION).collect()
    assert {(r.doc, r.code) for r in both} == {(1, c) for c in ("signature_lost", "slot_lost", "article_missing", "article_new", "header_missing", "addressee_lost")} | {(2, "baseline_missing")}


def test_what_explains_a_gap(spark):
    flow = [(1, 1, y, y + 10.0, 10.0, "line") for y in (0.0, 15.0, 30.0)] + [(1, 1, 60.0, 70.0, 10.0, "after"), (1, 1, 75.0, 85.0, 10.0, "end")]
    lines = spark.createDataFrame([*flow, (1, 1, None, None, None, None)], LINES)
    none = spark.createDataFrame([], BOXES)
    assert [(r.at, r.gap, r.median) for r in layout.spacing_outliers(lines, none, 200.0).collect()] == [(40.0, 20.0, 5.0)]
    for kind, y0, y1, left in (("image", 45.0, 50.0, 0), ("image", 61.0, 65.0, 1), ("table", 65.0, 66.0, 0), ("table", 75.0, 80.0, 1)):
        box = spark.createDataFrame([(1, 1, kind, 0.0, 1.0, y0, y1)], BOXES)
        assert layout.spacing_outliers(lines, box, 200.0).count() == left
    for at, change in ((3, {"size": 12.0}), (2, {"text": "Fig 1"})):
        other = [tuple({**dict(zip(("doc", "page", "y0", "y1", "size", "text"), r)), **(change if i == at else {})}.values()) for i, r in enumerate(flow)]
        assert layout.spacing_outliers(spark.createDataFrame(other, LINES), none, 200.0).count() == 0
    assert layout.spacing_outliers(lines, none, 45.0).count() == 0


def test_headers(spark):
    rows = [(1, 0, 0, 0, ""), (1, 0, 0, 1, "b"), (1, 0, 1, 0, "x"), (2, 0, 0, 0, " "), (2, 0, 0, 1, None), (2, 0, 1, 0, "x"), (3, 0, 0, 0, "a"), (3, 0, 0, 1, ""), (3, 0, 1, 1, "y"), (4, 0, 0, 0, "")]
    got = layout.header_blanks(spark.createDataFrame(rows, "doc long, tab long, row long, col long, text string")).collect()
    assert {(r.doc, r.col, r.label, r.pattern) for r in got} == {(1, 0, "x", "stub_head"), (2, None, None, "blank_band"), (3, 1, "a", None)}


def test_layout_states(spark):
    rows = [(1, p, 30.0 if p == 3 else 5.0, 1.0, 1) for p in (1, 2, 3)] + [(2, 1, 0.0, 0.0, 1)] + [(3, p, 40.0, 4.0, 1) for p in (1, 2)] + [(4, p, None, 5.0, 1) for p in (1, 2)] + [(5, p, 0.0, 0.0, 1) for p in range(9)]
    got = layout.layout_verdicts(spark.createDataFrame(rows, "doc long, page long, white double, gap double, figures long"), 2, 4, 1).collect()
    assert {(r.doc, r.state, r.needs, r.white_page, r.gap_page) for r in got} == {(1, "converged", "", 1, 1), (2, "underfilled", "expand", None, None), (3, "underfilled", "expand,remove_gap", 1, 1), (4, "gappy", "remove_gap", None, 1), (5, "overfilled", "tighten", None, None)}


def test_conversion_and_pointers(spark):
    pairs = spark.createDataFrame([(1, ["a", "b"], ["b", "a"]), (2, ["a"], ["a", "a"]), (3, ["a"], ["a"]), (4, None, []), (5, None, ["x"])], "key long, before array<string>, after array<string>")
    assert {(r.key, r.code) for r in layout.conversion_faults(pairs).collect()} == {(1, "order_drift"), (2, "content_differs"), (5, "content_differs")}
    stages = spark.createDataFrame([(1, 6, "done"), (2, 5, "done"), (3, 7, "open")], "ws long, stage long, status string")
    pointers = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "y")], "ws long, pointer string")
    found = layout.pointer_faults(stages, pointers, spark.createDataFrame([(3, "x")], "ws long, name string")).collect()
    assert {(r.ws, r.code) for r in found} == {(1, "canonical_null_after_done"), (4, "canonical_target_missing")}


def test_members_leave_in_small_batches():
    class Frame:
        """Takes the function that reads packages."""

        schema = {"id": type("Field", (), {"dataType": type("Type", (), {"simpleString": staticmethod(lambda: "bigint")})})}

        def select(self, *_):
            return self

        def mapInArrow(self, read, _):
            return read

    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array([b"none"] * 3000)], names=["id", "content"])
    out = list(files.members(Frame(), "id")(iter([batch])))
    assert sum(b.num_rows for b in out) == 3000 and max(b.num_rows for b in out) <= 1024
