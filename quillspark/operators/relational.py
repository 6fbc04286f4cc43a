"""Consistency rules over keyed rows: tolerance joins, totals, gaps, integrity, votes and percentiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.shared import materialize, task_partitions


def value_conflicts(rows: DataFrame, keys: list[str], value: str, limit: float = 0.01) -> DataFrame:
    """The keys, n, least, most, difference of keys whose values differ by more than `limit`, relative to the larger: of all pairs that is the worst."""
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    gap = (F.col("most") - F.col("least")) / F.greatest(F.abs("most"), F.abs("least"))
    return per.where(gap > limit).select(*keys, "n", "least", "most", F.round(gap, 6).alias("difference"))


def dangling(referring: DataFrame, defined: DataFrame, key: str, target: str) -> DataFrame:
    """ref, uses of references without a definition."""
    ids = defined.select(F.col(target).alias(key))
    return referring.join(ids, key, "left_anti").groupBy(F.col(key).alias("ref")).agg(F.count(F.lit(1)).alias("uses"))


def unreferenced(defined: DataFrame, target: str, referring: DataFrame, key: str) -> DataFrame:
    """id of definitions that nothing refers to."""
    return defined.join(referring.select(F.col(key).alias(target)), target, "left_anti").select(F.col(target).alias("id"))


def backed(values: DataFrame, results: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """id, value, backed: whether any result lies within a relative tolerance of the value (both positive).

    Values and results meet in logarithmic bands as wide as the tolerance. Of a band only the least and the greatest result can be the
    nearest to a value of a neighbouring band, and any is near enough in its own, so a band is one row however many results it has.
    """
    band = lambda c: F.floor(F.ln(c) / F.lit(-math.log1p(-tolerance))).cast("long")
    bands = results.where("result > 0").groupBy(band("result").alias("band")).agg(F.min("result").alias("least"), F.max("result").alias("most"))
    some = values.where("value > 0").select("value").distinct()
    near = some.select("value", F.explode(F.array(band("value") - 1, band("value"), band("value") + 1)).alias("band")).join(bands, "band")
    hit = near.where(T.close(F.col("value"), F.col("least"), tolerance) | T.close(F.col("value"), F.col("most"), tolerance)).select("value").distinct().withColumn("hit", F.lit(True))
    return values.join(hit, "value", "left").select("id", "value", F.coalesce("hit", F.lit(False)).alias("backed"))


def total_checks(orders: DataFrame, items: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """key, stated, summed, matches: the stated total of a group against the sum of its members."""
    sums = items.groupBy("key").agg(F.sum("amount").alias("summed"))
    joined = orders.join(sums, "key")
    return joined.select("key", "stated", F.round("summed", 2).alias("summed"), T.close(F.col("stated"), F.col("summed"), tolerance).alias("matches"))


def running_total(rows: DataFrame) -> DataFrame:
    """key, line, above: what stands above each row of its column."""
    w = Window.partitionBy("key").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("key", "line", F.round(F.coalesce(F.sum("amount").over(w), F.lit(0.0)), 2).alias("above"))


def numbering_gaps(rows: DataFrame) -> DataFrame:
    """key, n, last of groups whose distinct numbers aren't 1 to n."""
    per = rows.groupBy("key").agg(F.count_distinct("number").alias("n"), F.max("number").alias("last"), F.min("number").alias("first"))
    return per.where((F.col("first") != 1) | (F.col("last") != F.col("n"))).select("key", "n", "last")


def mode(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, n: the most frequent value of each key; ties go to the smallest."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("m"), value)).alias("b"))
    return best.select(F.col(key).alias("key"), F.col(f"b.{value}").alias("value"), F.col("b.n").alias("n"))


def nearest_rank(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, p50, p95 by nearest rank, and the interpolated median beside them; nulls don't count.

    Values are counted, dealt by range and written; the counts of a key in each range say where its ranks lie, so no task holds all values of a key.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranged = materialize(counted.repartitionByRange(task_partitions(rows), "key", "value").withColumn("range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("key", "range").agg(F.sum("n").alias("own"))
    by = Window.partitionBy("key").orderBy("range")
    sums = sums.select("key", "range", (F.sum("own").over(by) - F.col("own")).alias("before"), F.sum("own").over(Window.partitionBy("key")).alias("all"))
    placed = ranged.join(sums, ["key", "range"]).withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("key", "range").orderBy("value")))
    at = lambda rank: F.max(F.when((F.col("upto") - F.col("n") < rank) & (rank <= F.col("upto")), F.col("value")))
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
    out = placed.groupBy("key").agg(at(F.ceil(F.col("all") * 0.5)).alias("p50"), at(F.ceil(F.col("all") * 0.95)).alias("p95"), at(low).alias("low"), at(high).alias("high"))
    return out.select("key", "p50", "p95", F.round((F.col("low") + F.col("high")) / 2, 4).alias("median"))


def record_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """idx, change: records of two sequences by position: added, missing or changed. A record that is null is there."""
    both = left.select("idx", F.col("record").alias("a"), F.lit(True).alias("in_a")).join(right.select("idx", F.col("record").alias("b"), F.lit(True).alias("in_b")), "idx", "full_outer")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "missing").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select("idx", change.alias("change")).where("change is not null")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """value, surplus: how many more of each value the left has; equal counts are left out."""
    one = left.select("value", F.lit(1).alias("n")).unionByName(right.select("value", F.lit(-1).alias("n")))
    return one.groupBy("value").agg(F.sum("n").alias("surplus")).where("surplus <> 0")


def score_rollup(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """lang, source, runs, passed, toxic over all grouping sets of a roll-up; null stands for all."""
    joined = labels.join(docs.select("doc_id", "lang", "source"), "doc_id")
    return joined.rollup("lang", "source").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("quality") == 1).alias("passed"), F.sum("toxic").alias("toxic"))


def unique_word_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """word, doc_id, item_id: words that occur exactly once in all texts of either side."""
    once = lambda d, key: d.select(key, F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias(key)).where("n = 1").drop("n")
    return once(left, "doc_id").join(once(right, "item_id"), "word").select("word", "doc_id", "item_id")


def overlapping(intervals: DataFrame) -> DataFrame:
    """group, n, overlapping: intervals of a group that overlap an earlier one."""
    w = Window.partitionBy("group").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("reach", F.max("end").over(w)).groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("start") < F.col("reach")).alias("overlapping"))


def maximal_terms(terms: DataFrame) -> DataFrame:
    """term: those not contained in a longer one. Every term gives its parts of the lengths that other terms have, so terms meet by equality."""
    sizes = [r.n for r in terms.select(F.length("term").alias("n")).distinct().collect()]  # as many as lengths differ
    parts = lambda n: F.when(F.length("term") > n, F.transform(F.sequence(F.lit(1), F.greatest(F.length("term") - n + 1, F.lit(1))), lambda i: F.substr(F.col("term"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    held = terms.select(F.explode(F.array_distinct(F.concat(*[parts(n) for n in sorted(sizes) if n]))).alias("term")).distinct() if sizes else terms
    return terms.join(held, "term", "left_anti")


def next_cells(cells: DataFrame) -> DataFrame:
    """table, col, right: each cell with the next addressable one to its right."""
    return cells.select("table", "col", F.lead("text").over(Window.partitionBy("table").orderBy("col")).alias("right"))


def vocabulary_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """side, words: how many distinct words only the left has, only the right, or both."""
    words = lambda d: d.select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    a, b = words(left), words(right)
    sides = {"both": a.intersect(b), "left": a.subtract(b), "right": b.subtract(a)}
    counts = [d.agg(F.count(F.lit(1)).alias("words")).select(F.lit(name).alias("side"), "words") for name, d in sides.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def first_qualifying(rows: DataFrame, least: float) -> DataFrame:
    """key, line, value: the first row of each key whose value reaches `least`."""
    return rows.where(F.col("value") >= least).groupBy("key").agg(F.min(F.struct("line", "value")).alias("f")).select("key", "f.line", "f.value")


def unit_overlaps(boxes: DataFrame, least: float = 0.3, cell: int = 16) -> DataFrame:
    """page, boxes, hit: boxes (page, id, x0, y0, x1, y1: longs) and how many overlap another of their page by `least` of the smaller one's area.

    Boxes meet in the cells of a grid that they reach into, so that only near ones are compared.
    """
    reach = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    celled = boxes.withColumn("cx", F.explode(reach("x0", "x1"))).withColumn("cy", F.explode(reach("y0", "y1")))
    a, b = celled.alias("a"), celled.alias("b")
    side = lambda lo, hi: F.greatest(F.least(F.col(f"a.{hi}"), F.col(f"b.{hi}")) - F.greatest(F.col(f"a.{lo}"), F.col(f"b.{lo}")), F.lit(0))
    area = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.y1") - F.col(f"{t}.y0"))
    met = a.join(b, (F.col("a.page") == F.col("b.page")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.id") != F.col("b.id")))
    hit = met.where(side("x0", "x1") * side("y0", "y1") >= least * F.least(area("a"), area("b"))).select(F.col("a.page").alias("page"), F.col("a.id").alias("id")).distinct()
    counts = boxes.groupBy("page").agg(F.count(F.lit(1)).alias("boxes"))
    return counts.join(hit.groupBy("page").agg(F.count(F.lit(1)).alias("hit")), "page", "left").select("page", "boxes", F.coalesce("hit", F.lit(0)).alias("hit"))


def missing_requirements(required: DataFrame, enabled: DataFrame) -> DataFrame:
    """owner, item: what an owner requires (owner, item) that isn't enabled (item)."""
    return required.distinct().join(enabled.select("item").distinct(), "item", "left_anti").select("owner", "item")


def late_outputs(outputs: DataFrame, events: DataFrame, seconds: int = 600) -> DataFrame:
    """key, late: outputs (key, at) written more than `seconds` after the last event (key, at) of their key; those without an event are late too."""
    last = events.groupBy("key").agg(F.max("at").alias("last"))
    behind = F.col("last").isNull() | (F.col("at") > F.col("last") + seconds)
    return outputs.join(last, "key", "left").groupBy("key").agg(F.count_if(behind).alias("late")).where("late > 0")


def first_codes(texts: DataFrame, table: list[tuple[str, str]]) -> DataFrame:
    """id, code: of a table of (keyword, code) the code of the first keyword that a text (id, text) holds; null without any."""
    low = F.lower(F.coalesce("text", F.lit("")))
    return texts.select("id", F.coalesce(*[F.when(low.contains(k.lower()), F.lit(c)) for k, c in table]).alias("code"))


def level_order(modules: DataFrame, limit: int = 1000) -> DataFrame:
    """module, level of a graph (module, requires; null for none): 0 without requirements, else one more than the highest of those required. ValueError for a cycle.

    A round settles one level, and levels are written, so the plan of a deep graph stays short.
    """
    every = modules.select("module").distinct()
    edges = materialize(modules.where("requires is not null").select("module", "requires").distinct(), "edges")
    done = materialize(every.join(edges, "module", "left_anti").withColumn("level", F.lit(0).cast("long")), "levels")
    open_ = materialize(every.join(done, "module", "left_anti"), "open")
    for level in range(1, limit):
        if open_.isEmpty():
            return done
        blocked = edges.join(open_.select(F.col("module").alias("requires")), "requires", "left_semi").select("module")
        ready = materialize(open_.join(blocked, "module", "left_anti").withColumn("level", F.lit(level).cast("long")), "ready")
        if ready.isEmpty():
            break
        done = materialize(done.unionByName(ready), "levels")
        open_ = materialize(open_.join(ready, "module", "left_anti"), "open")
    raise ValueError("the modules' requirements hold a cycle")


def apportioned(rows: DataFrame) -> DataFrame:
    """key, part, width: a total (key, total, part, ratio) dealt to the parts by their ratios in whole units, each getting what the rounded sums up to it leave."""
    by = Window.partitionBy("key").orderBy("part")
    upto = F.floor(F.col("total") * F.sum("ratio").over(by) / F.sum("ratio").over(Window.partitionBy("key")))
    return rows.withColumn("upto", upto).select("key", "part", (F.col("upto") - F.coalesce(F.lag("upto").over(by), F.lit(0))).cast("long").alias("width"))
