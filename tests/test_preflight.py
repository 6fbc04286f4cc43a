"""Preflight in one scan, claims and sections of repeated ids, hot styles."""

from quillspark.operators import claims, contents, forms, preflight, text
from quillspark.plans.fixtures import DRAFTS


def test_every_checker_finds_its_cases_in_one_scan(spark, tmp_path):
    spark.createDataFrame([*DRAFTS, (-24, None), (-25, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    found = preflight.findings(docs)
    got = {}
    for r in found.where("doc_id = -21").collect():
        got.setdefault(r.checker, []).append((r.severity, r.line, r.detail))
    assert {k: sorted(v) for k, v in got.items()} == {
        "content": [("HARD", 1, "todo"), ("HARD", 3, "fill in here"), ("WARN", 11, "[[")],
        "style": [("WARN", 8, "in order to"), ("WARN", 12, "in order to"), ("WARN", 12, "very very")],
        "numbers": [("WARN", 1, "3.14"), ("WARN", 8, "9.75")],
        "refs": [("HARD", 8, "4")],
        "figures": [("HARD", 10, "a.png"), ("WARN", 9, "b.png")],
        "sources": [("HARD", 16, "2031"), ("WARN", 15, "https://x.org/a")],
        "units": [("WARN", 5, "mass")],
        "summary": [("HARD", 3, "7.25")],
        "claims": [("HARD", 8, "lee19")],
    }
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "Exchange" not in plan  # texts, and the rows without one, which only count as rows of verdicts
    told = {r.doc_id: r for r in preflight.verdicts(docs.where("doc_id < -21")).collect()}
    assert (told[-22].verdict, told[-22].checkers, told[-23].verdict, told[-24].verdict, told[-25].exit_code) == ("fail", "content,summary", "pass", "pass", 0)
    assert preflight.verdicts(docs.limit(0)).count() == 0 and preflight.verdicts(docs).count() == len(DRAFTS) + 2
    assert {r.checker for r in preflight.findings(docs, ["refs", "units"]).collect()} == {"refs", "units"}


def test_subjects_after_an_earlier_number_and_long_ones(spark):
    long = "very " * 40 + "beam mass"
    df = spark.createDataFrame([(1, "beam no 2 mass is 5.25 kg"), (2, f"{long} is 7.5 kg"), (3, "the load is 5 kg = 9 m")], "doc_id long, text string")
    got = {(r.doc_id, r.raw): (r.subject, r.unit) for r in claims.numeric_claims(df).collect()}
    assert got[1, "5.25"] == ("mass", "kg") and got[2, "7.5"] == (long, "kg")
    assert got[3, "5"] == ("load", "kg") and got[3, "9"] == (None, "m")


REPEATED = [(1, "# Summary\nalpha\nbeta\ngamma"), (1, "# References\nKim, A. (2020). One thing. https://x.org/a\n\n| a | b |\n| 1 | 2 |"), (1, "## SECTION: x\npara\n\n\n# End\n| a |\n| 1 | 2 |")]


def test_rows_of_one_id_are_kept_apart(spark):
    df = spark.createDataFrame(REPEATED, "doc_id long, text string").repartition(3)
    scopes = {r.scope: (r.lines, r.chars) for r in claims.section_scopes(df).collect()}
    assert scopes["summary"] == (3, 14) and scopes["references"][0] == 4
    assert sorted((r.lines, r.blanked) for r in claims.without_references(df).collect()) == [(4, 0), (5, 5), (7, 0)]
    assert [(r.entry, r.author) for r in claims.reference_entries(df).where("author is not null").collect()] == [(1, "Kim")]
    assert [(r.line, r.kind, r.text) for r in contents.content_blocks(df).where("kind = 'para'").orderBy("line").collect()][0] == (2, "para", "para")
    lines = text.keyed_lines(df)
    assert [tuple(r) for r in forms.ragged_tables(lines).collect()] == [(1, 7, 2, 1)]
    assert sorted((r.line, r.blanks) for r in forms.blanks_before(lines, lines.text.startswith("#")).collect()) == [(1, 0), (1, 0), (1, 0), (5, 2)]
    assert {(r.symptom, r.remedy) for r in contents.feedback_rows(df).collect()} == {("1", "2")}


def test_a_hot_style_is_dealt_over_tasks(spark):
    rows = [("font", "big", i, f"t{i}") for i in range(3000, 0, -1)] + [("font", "ok", 1, "x"), ("size", "9", 5, "only")]
    runs = spark.createDataFrame(rows, "kind string, value string, at long, text string").repartition(4)
    got = {r.value: (r.uses, r.places, r.sample) for r in forms.unallowed_styles(runs, spark.createDataFrame([("font", "ok")], "kind string, value string")).collect()}
    assert got == {"big": (3000, "1,2,3,4,5", "t1"), "9": (1, "5", "only")}
