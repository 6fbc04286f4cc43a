"""Reports, rules, schemas, catalogues and manifests on small cases, and the audit against its parts."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import contents
from quillspark.plans import contents_queries

EDGE = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "## SECTION: a\n[[EQ]]\nMet Ann Lee.\n| a | b |\n| c | d |")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("section", F.lit(1))


def test_null_empty_and_repeated_rows(edge, spark):
    for operator in (contents.content_blocks, lambda d: contents.tag_attributes(contents.content_blocks(d)), lambda d: contents.entities(d, []), lambda d: contents.phrase_caps(d, [("x", "x", 0)]), contents.feedback_rows):
        operator(edge).collect()
        assert operator(edge.limit(0)).count() == 0
    assert [tuple(r) for r in contents.phrase_caps(edge, [("x", "x", 0)]).collect()] == [(3, "x", 1)] * 2
    assert [(r.doc_id, r.symptom, r.remedy) for r in contents.feedback_rows(edge).collect()] == [(None, "c", "d")]


def test_blocks_of_a_report(spark):
    text = dict(contents_queries.MARKED)[-21]
    got = contents.content_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("line").collect()
    assert [(r.line, r.section, r.kind) for r in got] == [(2, None, "tag_outside"), (4, "One", "para"), (7, "One", "para"), (8, "One", "fig"), (9, "One", "para"), (10, "One", "table"), (11, "One", "row"), (13, "One", "row"), (15, "One", "para")]
    assert got[1].text == "first line second line"


def test_title_pattern():
    assert re.search(contents.title_pattern("Report {n}: {name}."), "Report 3: x.") and not re.search(contents.title_pattern("Report {n}."), "Report 3!")


@pytest.mark.parametrize(("json", "errors"), [('{"a": {"b": []}}', ["$.a.b: type string"]), ('{"a": {"b": "x"}}', []), ('{"a": null}', ["$.a: type object"]), ("{}", ["$.a: missing"]), ('{"a": {"b": "y"}}', ["$.a.b: enum"]), (None, ["$: no JSON"]), ('{"a": {"b": "x"}, "l": [[1], [2, "s"], 3]}', ["$.l[1][1]: type number", "$.l[2]: type array"])])
def test_nested_schemas(spark, json, errors):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "object", "properties": {"b": {"type": "string", "enum": ["x"]}}}, "l": {"type": "array", "items": {"type": "array", "items": {"type": "number"}}}}}
    got = contents.schema_errors(spark.createDataFrame([(1, json)], "id long, t string"), "id", "t", schema).collect()
    assert sorted(r.error for r in got) == errors


def test_captions_after_objects_only(spark):
    rows = [(1, 0, "paragraph", "Fig 0"), (1, 1, "table", None), (1, 2, "paragraph", "Fig 1"), (1, 3, "paragraph", "Fig 2"), (1, 4, "picture", "p"), (1, 5, "paragraph", None)]
    got = contents.attached_captions(spark.createDataFrame(rows, "doc long, seq long, kind string, text string"), "^Fig").orderBy("seq").collect()
    assert [(r.seq, r.caption) for r in got] == [(0, None), (1, "Fig 1"), (3, None), (4, None), (5, None)]


def test_empty_catalogues(spark):
    modules, needs, names = (spark.createDataFrame([], s) for s in ("module string, version string", "module string, needs string, least string", "module string, name string"))
    assert contents.module_faults(modules, needs, names).count() == 0
    one = spark.createDataFrame([("a", None), ("a", "1.0.0")], "module string, version string")
    assert {(r.module, r.code) for r in contents.module_faults(one, needs, names).collect()} == {("a", "duplicate"), ("a", "version")}


def test_audit_counts_what_its_parts_find(spark, edge):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = contents.audit(edge, {"a": ("HARD", rows(1, 1)), "b": ("WARN", rows(1, 2)), "c": ("WARN", rows(9))}).collect()
    assert {tuple(r) for r in got} == {(1, 2, 1, "a,b", 3), (2, 0, 1, "b", 0), (3, 0, 0, "", 0), (None, 0, 0, "", 0)}


def test_audit_counts_findings_of_documents_without_an_id(spark, edge):
    one = spark.createDataFrame([(None,)], "doc_id long")
    assert (None, 1, 0, "a", 3) in {tuple(r) for r in contents.audit(edge, {"a": ("HARD", one)}).collect()}


AUDITED = [
    (1, 'see "fill in here" or fill in here, aand thehha'), (2, "C:\\Users\\\x1ckim C:\\Users\\me\\x"), (3, "C:\\Users\\kim\x1dx\x1e/home/lee"), (4, "x\x1d900101-1234567\u2028010 - 1234-5678"), (5, "1900101-1234567 a - b 1-2"),
    (6, "As Kim (2020) says"), (6, "# references \nKim, A. (2020). T."), (7, "As Kim (2020)\n# Bibliography\nLee, A. (2020). T.\nKim (2021)"), (8, "span = 3 m"), (8, "x\nthe span is 3 kg"), (9, "span = 3 m, of width 4 kg"),
    (10, "Aaaa"), (11, "aaa"), (11, 'aa "aa"'), (12, None), (13, ""), (None, "hha hha hha"),
]


def test_audited_texts(spark):
    docs = spark.createDataFrame(AUDITED, "doc_id long, text string")
    got = contents.content_audit(docs, ["fill in here", "hha", "and the", "aa"], '"[^"\n]*"', [("many", "hha", 2), ("bracket", "[(]", 0)]).collect()
    want = {1: (4, 0, "forbidden"), 3: (2, 0, "user_paths"), 4: (2, 0, "identity_numbers"), 6: (0, 2, "phrase_caps"), 7: (0, 2, "phrase_caps,unlisted_citations"), 8: (0, 1, "unit_mismatches"), 10: (3, 0, "forbidden"), 11: (3, 0, "forbidden"), None: (3, 1, "forbidden,phrase_caps")}
    assert {tuple(r) for r in got} == {(i, *want.get(i, (0, 0, "")), 3 if want.get(i, (0,))[0] else 0) for i, _ in AUDITED} and len(got) == 14


def test_audit_reads_documents_in_one_pass(spark, sf):
    plan = contents_queries.QUERIES["content_audit"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # a checker on all texts would scan them anew; what they hand on has no other columns of the table
    assert plan.count("n_chars") == 0 and contents_queries.QUERIES["phrase_caps"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("n_chars") == 1


def test_content_audit(spark, sf):
    got = contents_queries.QUERIES["content_audit"](spark, sf).collect()
    assert len({r.doc_id for r in got}) == len(got)
    assert {c for r in got for c in r.checkers.split(",")} == {"", "forbidden", "user_paths", "identity_numbers", "unit_mismatches", "unlisted_citations", "phrase_caps"}
    assert all((r.exit_code == 3) == (r.hard > 0) and (r.checkers == "") == (r.hard + r.warn == 0) for r in got)
