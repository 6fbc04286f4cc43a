"""Layered settings, and the SQL that they equal: a fold of merges over each key's layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packs
from ..sources.tables import read_table

# each line of an order is a layer of settings: objects, values in their place, lists and empty objects
_TEXT = """CASE n % 4 WHEN 0 THEN concat('{{"a":{{"q":', CAST(p AS {string}), ',"s":{{"f":"', f, '"}}}},"e":{{}}}}') WHEN 1 THEN concat('{{"a":{{"s":{{"t":"', t, '"}},"q":', CAST(s AS {string}), '}},"b":[1,', CAST(n AS {string}), ']}}')
    WHEN 2 THEN concat('{{"a":{{"s":"', f, '"}}}}') ELSE concat('{{"a":{{"s":{{"f":{{"g":', CAST(s AS {string}), '}}}}}},"b":{{"x":1}},"e":{{"y":{{}}}}}}') END"""
_LAYERS = "SELECT l_orderkey AS key, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_returnflag) AS f, min(l_linestatus) AS t FROM lineitem GROUP BY l_orderkey, l_linenumber"


def merged_packs(spark, sf_dir):
    least = [F.min(c).alias(a) for a, c in (("p", "l_partkey"), ("s", "l_suppkey"), ("f", "l_returnflag"), ("t", "l_linestatus"))]
    layers = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("n")).agg(*least)
    layers = layers.selectExpr("key", "n AS priority", f"{_TEXT.format(string='string')} AS text")
    return packs.merged_layers(layers).select("key", "path", "value")


QUERIES = {"merged_packs": merged_packs}

ORACLE_SQL = {
    "merged_packs": f"""
        WITH l AS (SELECT key, n, CAST({_TEXT.format(string='VARCHAR')} AS JSON) AS j FROM ({_LAYERS})),
        m AS (SELECT key, list_reduce(list(j ORDER BY n), lambda a, b: json_merge_patch(a, b)) AS j FROM l GROUP BY key)
        SELECT m.key, replace(replace(t.fullkey, '$', ''), '.', '/') AS path, CAST(t.value AS VARCHAR) AS value FROM m, json_tree(j) AS t WHERE NOT contains(t.fullkey, '[') AND (t.type <> 'OBJECT' OR CAST(t.value AS VARCHAR) = '{{}}')""",
}
