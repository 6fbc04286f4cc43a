"""Queries that SQL cannot express, against brute force, and the report operators on null, empty and repeated rows."""

import difflib
import json
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import claims, forms, gates, privacy, relational, reuse, text, workflow
from quillspark.plans import claims_queries, forms_queries, queries
from quillspark.plans.fixtures import FORBIDDEN, PRIVATE, REPORTS

WORD = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")
EDGE = [(1, None), (2, ""), (3, "one. two"), (3, "one. two"), (None, "three\n# x\n| a |"), (4, "[1] Kim (2020) " * 40)]


@pytest.fixture(scope="module")
def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return [*((r.doc_id, r.text) for r in rows), *REPORTS]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("extra", F.lit(1))


def lines_of(t):
    return re.split("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", t or "")


def words_of(t):
    return WORD.findall((t or "").lower().replace("ß", "ss"))


def test_citation_markers(spark, sf, texts):
    want = []
    for d, t in texts:
        for n, line in enumerate(lines_of(t), 1):
            every = sorted((m.start(), -len(m.group()), kind, m.group()) for kind, p in claims.CITATIONS for m in re.finditer(p, line))
            end = 0
            for start, short, kind, marker in every:
                if start >= end:
                    end = start - short
                    want.append((d, n, start, kind, marker))
    got = [tuple(r) for r in claims_queries.QUERIES["citation_markers"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and len({k for *_, k, _ in want}) == 4


def test_residue(spark, sf, texts):
    want = []
    for d, t in texts:
        low = (t or "").lower()
        spans = [m.span() for m in re.finditer('"[^"\n]*"', low)]
        for (p,) in FORBIDDEN:
            for i in range(len(low) - len(p) + 1):
                if low[i : i + len(p)] == p and not any(a <= i and i + len(p) <= b for a, b in spans):
                    want.append((d, i, p, re.sub("[\r\n]", " ", t[max(0, i - 40) : i + len(p) + 40])))
    assert sorted(map(tuple, forms_queries.QUERIES["residue"](spark, sf).collect())) == sorted(want)
    df = spark.createDataFrame([(1, 'aaaa "aaa" aaa')], "doc_id long, text string")
    assert sorted(r.start for r in forms.residue(df, ["aa"], '"[^"]*"').collect()) == [0, 1, 2, 11, 12]


def test_title_coverage(spark, sf, texts):
    def covers(short, long):
        rest = iter(long)
        return all(w in rest for w in short)

    items = {r.item_id: words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(i, d) for i, s in items.items() if len(s) >= 3 for d, t in texts if d >= 0 and covers(s, words_of(t))}
    assert {tuple(r) for r in queries.QUERIES["title_coverage"](spark, sf).collect()} == want and want


def test_title_matches(spark, sf):
    pages = {r.page_id: re.search("<title>([^<]*)</title>", r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    known = {i: m[1] for i, m in pages.items() if m}
    changed = {i: t + "s" if i % 3 == 0 else "on " + t if i % 3 == 1 else t[::-1] for i, t in known.items()}
    rows = claims_queries.QUERIES["title_matches"](spark, sf).collect()
    of = {kind: {r.id: r.other_id for r in rows if r.kind == kind} for kind in ("cited", "known")}
    matched = {(r.id, r.other_id): r.ratio for r in rows if r.kind == "match"}
    # every pair of rows, from the pairs of their classes
    got = {(i, j): matched[a, b] for i, a in of["cited"].items() for j, b in of["known"].items() if (a, b) in matched}
    for i, a in changed.items():
        for j, b in known.items():
            ratio = difflib.SequenceMatcher(None, a.lower(), b.lower(), autojunk=False).ratio()
            # titles that share none of their rare words aren't compared
            assert ratio < 0.92 or (i, j) in got or not set(words_of(a)) & set(words_of(b))
            assert (i, j) not in got or abs(got[i, j] - ratio) < 1e-6
    assert sum((i, i) in got for i in known) > 0.4 * len(known)


def test_best_grids(spark, sf):
    rows = [(r.l_suppkey, r.l_partkey % 40, f"{r.l_returnflag}{int(r.l_quantity)}") for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect()]
    base, have = {}, {}
    for doc, grid, label in rows:
        base.setdefault(doc, {}).setdefault(grid, set()).add(label)
        if (grid + len(label)) % 7:
            have.setdefault(doc, {}).setdefault(grid, set()).add(label)
    want = []
    for doc, grids in base.items():
        pairs = sorted((-round(len(s & t) / len(s) + 0.001 * (len(s) == len(t)), 6), g, m) for g, s in grids.items() for m, t in have.get(doc, {}).items() if len(s & t) >= 0.6 * len(s))
        taken, used = {}, set()
        for score, g, m in pairs:
            if g not in taken and m not in used:
                taken[g] = (m, -score)
                used.add(m)
        want += [(doc, g, *taken.get(g, (None, None))) for g in grids]
    assert sorted(map(tuple, forms_queries.QUERIES["best_grids"](spark, sf).collect()), key=repr) == sorted(want, key=repr)


def test_operators_on_null_empty_and_repeated_rows(edge, spark):
    for operator in (claims.numeric_claims, claims.bindings, claims.section_scopes, claims.without_references, claims.reference_entries, claims.citation_markers, claims.unlisted_citations, text.repeated_tics, text.sentence_counts, text.tag_masks, text.bold_segments, privacy.identity_numbers, privacy.named_numbers):
        operator(edge).collect()
        assert operator(edge.limit(0)).count() == 0
    assert [r.n for r in claims.citation_markers(edge).groupBy("doc_id").agg(F.count("*").alias("n")).collect()] == [80]
    assert [tuple(r) for r in text.sentence_counts(edge).where("doc_id = 3").collect()] == [(3, 2, 2, 2, 2)] * 2
    assert [tuple(r) for r in forms.ragged_tables(text.line_rows(edge)).collect()] == []


def test_numeric_leaves_at_any_depth(spark):
    rows = [json.dumps({"a": [1, {"b": 2.5}, True], "c": "3"}), "not json", None, "[NaN, 4]", "7"]
    got = [r.x for r in spark.createDataFrame([(r,) for r in rows], "t string").select(claims.numeric_leaves("t").alias("x")).collect()]
    assert got == [[1.0, 2.5], [], [], [4.0], [7.0]]


def test_normal_forms_and_ratio(spark):
    df = spark.createDataFrame([("e\u0301", "ﬁ", "abcd", "bcde"), (None, None, None, "x")], "a string, b string, c string, d string")
    got = df.select(claims.composed("a").alias("a"), claims.compatible("b").alias("b"), claims.edit_ratio("c", "d").alias("r")).collect()
    assert [tuple(r) for r in got] == [("é", "fi", 0.75), (None, None, None)]


def test_findings_agree_with_their_counts(spark):
    docs = spark.createDataFrame(PRIVATE, "doc_id long, text string")
    found = privacy.rollup(docs, privacy.findings(docs, ["text"])).collect()
    counted = privacy.verdicts(privacy.counted_findings(docs, ["text"])).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, counted))
    assert {(r.doc_id, r.kind) for r in privacy.identity_numbers(docs).collect()} == {(d, k) for d in (-12, -14) for k in ("resident", "phone")}


def test_nearest_ranks_of_ties_nulls_and_one_row(spark):
    rows = [("a", v) for v in (5.0, 1.0, 1.0, None, 9.0)] + [("b", 2.0)]
    got = {r.key: (r.p50, r.p95, r.median) for r in relational.nearest_rank(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {"a": (1.0, 9.0, 3.0), "b": (2.0, 2.0, 2.0)}


def test_cycles_are_refused(spark):
    with pytest.raises(ValueError, match="cycle"):
        relational.level_order(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "module string, requires string"))


def test_reset_takes_back_later_stages(spark):
    rows = [(1, 0, "approve", "2024-01-01", 1), (1, 1, "approve", "2024-01-02", 2), (1, 1, "reset", "2024-01-03", 3), (1, 2, "reject", "2024-01-04", 4), (1, 3, "open", "2024-01-05", 5)]
    log = spark.createDataFrame(rows, "ws long, stage long, kind string, ts string, event_id long")
    gates = workflow.gate_states(log)
    assert sorted((r.stage, r.gate) for r in gates.collect()) == [(0, "approved"), (1, "pending"), (2, "rejected"), (3, "pending")]
    assert sorted((r.stage, r.blocked) for r in workflow.stage_blocks(gates).collect()) == [(0, False), (1, False), (2, True), (3, True)]


def test_reuse_of_empty_tables(spark, edge):
    items = edge.select(F.col("doc_id").alias("item_id"), "text")
    assert reuse.reused_passages(edge.limit(0), items).count() == 0 and reuse.reused_passages(edge, items.limit(0)).count() == 0


def test_canonical_json_refuses_what_is_ambiguous(spark):
    rows = ['{"b": 1, "a": [true, null, "é"]}', '{"a": 1, "a": 2}', "NaN", '{"x": Infinity}', "", None, "[1, 2.50]"]
    got = [r.canonical for r in gates.canonical_rows(spark.createDataFrame(list(enumerate(rows)), "id long, t string"), "id", "t").orderBy("id").collect()]
    assert got == ['{"a":[true,null,"é"],"b":1}', None, None, None, None, None, "[1,2.5]"]


def test_title_coverage_sends_tokens_without_their_texts(spark, capsys):
    docs = spark.createDataFrame([(1, "b a c d"), (1, "d c b a"), (1, "b a c d"), (None, "a x b y c"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a c d"), (8, "a b c"), (9, "a b")], "item_id long, text string")
    found = text.title_coverage(items, docs)
    assert sorted(map(str, map(tuple, found.collect()))) == ["(7, 1)", "(7, 1)", "(8, None)"]
    found.explain()
    spread_out = re.findall(r"Generate explode\(array_distinct\(.*\)\), \[(.*?)\], false", capsys.readouterr().out)
    assert spread_out and all(re.fullmatch(r"(own|item_id)#\d+L?", kept) for kept in spread_out)


def test_title_matches_pairs_classes_of_equal_titles(spark):
    copies, other = "one rare mountain of glass", "quite another book on rivers"
    cited = spark.createDataFrame([(i, copies + "s") for i in range(40)] + [(50, other), (51, None), (52, "")], "id long, title string")
    known = spark.createDataFrame([(100 + i, copies) for i in range(40)] + [(200, other.upper())], "id long, title string")
    rows = claims.title_matches(cited, known).collect()
    assert sorted((r.id, r.other_id, r.ratio) for r in rows if r.kind == "match") == [(0, 100, round(52 / 53, 6)), (50, 200, 1.0)]
    assert sorted((r.id, r.other_id) for r in rows if r.kind == "cited") == [(i, 0) for i in range(40)] + [(50, 50), (52, 52)]
    assert sorted((r.id, r.other_id) for r in rows if r.kind == "known") == [(100 + i, 100) for i in range(40)] + [(200, 200)]
