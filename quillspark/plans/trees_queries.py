"""Orders as trees of JSON, aligned and digested, and the SQL that they equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trees
from ..sources.tables import read_table
from .shared import dealt, scan_partitions


def _orders(spark, sf_dir):
    keys = ["n", "flag", "state", "tens"]  # lines that are equal in these are equal in the text
    lines = dealt(read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc", "l_linenumber AS n", "l_returnflag AS flag", "l_linestatus AS state", "CAST(floor(l_quantity / 10) AS long) AS tens"), "doc")
    line = F.struct(*(x for k in keys for x in (F.col(k).isNull().alias(f"no_{k}"), k)))  # nulls come last
    shown = lambda x: F.struct(x["flag"].alias("flag"), F.struct(x["state"].alias("state"), x["tens"].alias("tens")).alias("more"))
    lines = lines.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(line)), shown).alias("lines"))
    return lines.select("doc", F.to_json(F.struct(F.lit("order").alias("kind"), "lines"), {"ignoreNullFields": "false"}).alias("text"))


def aligned_paths(spark, sf_dir):
    return trees.aligned(trees.tree_nodes(_orders(spark, sf_dir)))


def repeated_subtrees(spark, sf_dir):
    return trees.repeated_in_texts(_orders(spark, sf_dir), partitions=scan_partitions(read_table(spark, sf_dir, "lineitem").select("l_orderkey")))


QUERIES = {"aligned_paths": aligned_paths, "repeated_subtrees": repeated_subtrees}

_NODES = """
        WITH o AS (SELECT l_orderkey AS doc, to_json({'kind': 'order', 'lines': list({'flag': l_returnflag, 'more': {'state': l_linestatus, 'tens': CAST(floor(l_quantity / 10) AS BIGINT)}} ORDER BY l_linenumber, l_returnflag, l_linestatus, CAST(floor(l_quantity / 10) AS BIGINT), l_partkey)}) AS j FROM lineitem GROUP BY 1),
        t AS (SELECT o.doc, t.id, t.parent, t.fullkey AS path, CASE WHEN t.parent IS NULL OR ends_with(t.fullkey, ']') THEN '' ELSE t.key END AS tag, CASE WHEN t.type NOT IN ('OBJECT', 'ARRAY') THEN CAST(t.value AS VARCHAR) END AS value FROM o, json_tree(o.j) AS t)"""


def _levels(n: int) -> str:
    """d<n>: digests of the nodes of each depth, from the leaves at the deepest one up."""
    out = ["p0 AS (SELECT *, 0 AS depth FROM t WHERE parent IS NULL)"] + [f"p{i} AS (SELECT t.*, {i} AS depth FROM t JOIN p{i - 1} AS p ON t.doc = p.doc AND t.parent = p.id)" for i in range(1, n + 1)]
    for i in range(n, -1, -1):
        below = f"LEFT JOIN (SELECT doc, parent, string_agg(digest, ',' ORDER BY id) AS inner_, sum(size) AS n FROM d{i + 1} GROUP BY 1, 2) AS b ON b.doc = p.doc AND b.parent = p.id" if i < n else ""
        inner, size = ("coalesce(b.inner_, '')", "1 + coalesce(b.n, 0)") if i < n else ("''", "1")
        out.append(f"d{i} AS (SELECT p.doc, p.id, p.parent, CAST({size} AS BIGINT) AS size, sha256(p.tag || '(' || {inner} || ')' || coalesce(p.value, '')) AS digest FROM p{i} AS p {below})")
    return ",\n        ".join(out)


ORACLE_SQL = {
    "aligned_paths": f"""{_NODES}, k AS (SELECT path, count(DISTINCT doc) AS documents, (SELECT count(*) FROM o) - count(DISTINCT doc) AS absent, count(DISTINCT coalesce(value, '')) AS values FROM t GROUP BY 1)
        SELECT *, CASE WHEN absent > 0 THEN 'skeleton' WHEN values > 1 THEN 'value' ELSE 'none' END AS difference FROM k""",
    "repeated_subtrees": f"""{_NODES}, {_levels(4)},
        e AS ({' UNION ALL '.join(f'SELECT doc, size, digest FROM d{i}' for i in range(5))})
        SELECT digest, size, count(*) AS places, count(DISTINCT doc) AS documents FROM e WHERE size >= 2 GROUP BY 1, 2 HAVING places > 1""",
}
