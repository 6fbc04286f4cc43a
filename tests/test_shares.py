"""A task's share of a shuffle follows from its query, not from the size of the table."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import forms, layout, workflow
from quillspark.plans.queries import QUERIES
from quillspark.plans.shared import scan_partitions, spread, task_partitions
from quillspark.sources.tables import read_table


@pytest.fixture
def many_scans(spark):
    """The small table is scanned as a large one is, in many partitions."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    was = {x: spark.conf.get(x) for x in names}
    for x in names:
        spark.conf.set(x, "8k")
    yield
    for x, value in was.items():
        spark.conf.set(x, value)


def exchanges(df, capsys):
    """(keys, partitions) of the plan's shuffles by key."""
    df.explain()
    return [(keys, int(n)) for keys, n in re.findall(r"hashpartitioning\((.*?), (\d+)\)", capsys.readouterr().out)]


@pytest.mark.parametrize("name", ["cell_neighbours", "layout_verdicts", "cell_kinds", "inventory", "mixed_rows"])
def test_a_table_is_shuffled_once_by_its_size(spark, sf, many_scans, capsys, name):
    scan = read_table(spark, sf, "lineitem")
    want = scan_partitions(scan.select("l_orderkey"))
    large = [(keys, n) for keys, n in exchanges(QUERIES[name](spark, sf), capsys) if "#" in keys and not keys.startswith(("kind#", "stage#", "name#"))]
    assert want > 2 * task_partitions(scan)
    assert len(large) == 1 and large[0][1] >= want and "," not in large[0][0]


def test_best_grids_counts_pairs_where_documents_are_dealt(spark, sf, many_scans, capsys):
    large = [keys for keys, n in exchanges(QUERIES["best_grids"](spark, sf), capsys) if n > 2 * task_partitions(spark.range(1))]
    assert len(large) == 1 and re.fullmatch(r"doc#\d+L?", large[0])


def test_best_grids_of_nulls_and_repeated_rows(spark):
    schema = "doc long, grid long, label string"
    base = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 1, None), (1, 2, "b"), (1, 3, None), (1, None, "a"), (None, 1, "a"), (2, 1, "a")], schema)
    own = spark.createDataFrame([(1, 7, "a"), (1, 7, "a"), (1, 7, None), (1, 8, "c"), (1, None, "b"), (None, 7, "a")], schema)
    got = {tuple(r) for r in forms.best_grids(own, base, partitions=3).collect()}
    assert got == {(1, 1, 7, 1.001), (1, 2, None, None), (1, 3, None, None), (1, None, None, None), (None, 1, None, None), (2, 1, None, None)}


def test_layout_of_null_and_repeated_pages(spark):
    rows = [(1, 1, 30.0, 0.0, 1), (1, 2, 90.0, None, 1), (1, 2, 95.0, 5.0, 1), (1, None, 99.0, 9.0, 1), (2, None, 50.0, 1.0, 0), (None, 1, 50.0, 1.0, 0)]
    got = layout.layout_verdicts(spark.createDataFrame(rows, "doc long, page long, white double, gap double, figures long"), 2, 4, 1).orderBy("doc").collect()
    assert [(r.doc, r.pages, r.worst_white, r.white_page, r.worst_gap, r.gap_page, r.state) for r in got] == [(1, 2, 30.0, 1, 9.0, None, "underfilled"), (2, 0, 0.0, None, 1.0, None, "underfilled")]


def test_inventory_of_null_names_and_repeated_rows(spark):
    files = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("b", "other"), (None, "x")], "ws string, name string")
    wanted = spark.createDataFrame([(1, "x", True), (1, "x", True), (1, "y", False), (2, None, True), (3, "y", None)], "stage long, name string, needed boolean")
    got = {tuple(r) for r in workflow.inventory(files, wanted).select(F.coalesce("ws", F.lit("?")), "stage", "required", "present", "complete").collect()}
    assert got == {("a", 1, 2, 2, True), ("a", 2, 1, 0, False), ("a", 3, 0, 0, True), ("b", 1, 2, 0, False), ("b", 2, 1, 0, False), ("b", 3, 0, 0, True), ("?", 1, 2, 0, False), ("?", 2, 1, 0, False), ("?", 3, 0, 0, True)}


def test_texts_are_dealt_whatever_their_row_groups(spark, sf, capsys):
    scan = read_table(spark, sf, "documents").select("doc_id", "text")
    assert spread(scan.repartition(100)).rdd.getNumPartitions() == scan_partitions(scan.repartition(100))
    QUERIES["repeated_tics"](spark, sf).explain()
    assert "RoundRobinPartitioning" in capsys.readouterr().out


def test_content_blocks_read_texts_once_and_deal_them_whole(spark, sf, many_scans, capsys):
    scan = read_table(spark, sf, "documents").select("doc_id", "text")
    by_key = exchanges(QUERIES["content_blocks"](spark, sf), capsys)
    assert len(by_key) == 1 and by_key[0][1] == scan_partitions(scan) > 2 * task_partitions(scan)


def test_repeated_subtrees_shuffle_orders_and_counts_and_write_no_nodes(spark, sf, many_scans, capsys):
    scan = read_table(spark, sf, "lineitem").select("l_orderkey")
    by_key = exchanges(QUERIES["repeated_subtrees"](spark, sf), capsys)
    assert [re.sub(r"#\d+L?", "", keys) for keys, _ in by_key] == ["digest, size", "doc"]
    assert {n for _, n in by_key} == {scan_partitions(scan)} and scan_partitions(scan) > 2 * task_partitions(scan)
