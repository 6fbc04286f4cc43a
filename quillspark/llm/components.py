"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of `edges` (a, b: longs).

    Each pass takes the least label among a node's neighbours and then that label's own label, so
    the passes needed grow with the logarithm of a component's width. Every pass is a written table; hubs
    are joined by split partitions, never gathered. Repeated edges do no harm.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b"), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("least"))
        once = labels.join(near, labels.node == near.a).select("node", F.least("component", "least").alias("component"), F.col("component").alias("was"))
        once = materialize(once, "labels")
        jump = once.select(F.col("node").alias("target"), F.col("component").alias("next"))
        twice = once.join(jump, once.component == jump.target, "left").select("node", F.least("component", F.coalesce("next", "component")).alias("component"), "was")
        twice = materialize(twice, "labels")
        labels = twice.select("node", "component")
        if twice.where("component <> was").isEmpty():
            return labels


def merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """`labels` (node, component; of earlier edges) after more `edges`: only their components are joined, so a call costs what is new."""
    if labels is None:
        return components(edges)
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b")).where("a <> b").distinct()
    between = materialize(between, "between")
    if between.isEmpty():
        return labels
    found = components(between)
    moved = labels.join(found.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return materialize(moved.unionByName(found.join(labels.select("node"), "node", "left_anti")), "labels")
