"""Forms as relations: cells and seats of tables, compared with the blank form that they come from."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.shared import materialize, task_partitions

ADDRESS = ["doc", "tab", "row", "col"]


def squeezed(text: Column) -> Column:
    """Without white space; null as empty."""
    return T.squeeze(F.coalesce(text, F.lit("")))


def cell_changes(cells: DataFrame, baseline: DataFrame) -> DataFrame:
    """doc, tab, row, col, change of the baseline's cells by address: removed, filled (was empty), emptied or changed; without those that stayed."""
    a = baseline.select(*ADDRESS, squeezed(F.col("text")).alias("was"))
    b = cells.select(*ADDRESS, squeezed(F.col("text")).alias("now"))
    change = F.when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), None).when(F.col("was") == "", "filled").when(F.col("now") == "", "emptied").otherwise("changed")
    return a.join(b, ADDRESS, "left").select(*ADDRESS, change.alias("change")).where("change is not null")


def seats_changed(cells: DataFrame, baseline: DataFrame) -> DataFrame:
    """doc, changed: how many of the baseline's seats have a text that no cell of the document has."""
    has = cells.select("doc", squeezed(F.col("text")).alias("t")).distinct()
    gone = baseline.select("doc", squeezed(F.col("text")).alias("t")).join(has, ["doc", "t"], "left_anti")
    return baseline.select("doc").distinct().join(gone.groupBy("doc").agg(F.count(F.lit(1)).alias("n")), "doc", "left").select("doc", F.coalesce("n", F.lit(0)).alias("changed"))


def mixed_rows(cells: DataFrame) -> DataFrame:
    """doc, tab, row, filled, blank: rows of more than one cell that mix both."""
    empty = squeezed(F.col("text")) == ""
    counts = cells.groupBy("doc", "tab", "row").agg(F.count_if(~empty).alias("filled"), F.count_if(empty).alias("blank"))
    return counts.where("filled > 0 AND blank > 0")


def neighbours(cells: DataFrame) -> DataFrame:
    """doc, tab, row, col, right, below: each cell with the text of the next addressable one to the right and below (null without one)."""
    right = F.lead("text").over(Window.partitionBy("doc", "tab", "row").orderBy("col"))
    below = F.lead("text").over(Window.partitionBy("doc", "tab", "col").orderBy("row"))
    return cells.select(*ADDRESS, right.alias("right"), below.alias("below"))


def cell_kinds(cells: DataFrame) -> DataFrame:
    """kind, cells: label (not empty), fill_target (empty, right of or below a label) or spacer."""
    filled = squeezed(F.col("text")) != ""
    left = F.lag(filled).over(Window.partitionBy("doc", "tab", "row").orderBy("col"))
    above = F.lag(filled).over(Window.partitionBy("doc", "tab", "col").orderBy("row"))
    kind = F.when(filled, "label").when(F.coalesce(left, F.lit(False)) | F.coalesce(above, F.lit(False)), "fill_target").otherwise("spacer")
    return cells.select(kind.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("cells"))


def seat_states(seats: DataFrame, terms: list[str]) -> DataFrame:
    """doc, seat, state of seats (doc, seat, text): what is left of guide terms and of text beside them.

    blank_by_design: neither; filled: text alone; emptied: terms alone; half_filled: both. Terms are taken out longest first.
    """
    residual = squeezed(F.col("text"))
    own = [t.replace(" ", "") for t in sorted(terms, key=lambda t: (-len(t), t))]
    held = F.lit(False)
    for t in own:
        held = held | squeezed(F.col("text")).contains(t)
        residual = F.replace(residual, F.lit(t), F.lit(""))
    rest = F.regexp_replace(residual, "[_.·○□]", "")
    state = F.when(held & (rest != ""), "half_filled").when(held, "emptied").when(rest != "", "filled").otherwise("blank_by_design")
    return seats.select("doc", "seat", state.alias("state"))


def form_states(cells: DataFrame, baseline: DataFrame, dated: Column) -> DataFrame:
    """doc, state: blank if no cell of the baseline was filled or changed, final if one was and a cell is dated, else draft."""
    wrote = cell_changes(cells, baseline).where("change IN ('filled', 'changed')").select("doc").distinct().withColumn("wrote", F.lit(True))
    with_date = cells.groupBy("doc").agg(F.max(F.coalesce(dated, F.lit(False))).alias("dated"))
    state = F.when(F.col("wrote").isNull(), "blank").when(F.col("dated"), "final").otherwise("draft")
    return with_date.join(wrote, "doc", "left").select("doc", state.alias("state"))


def geometry_changes(cells: DataFrame, baseline: DataFrame) -> DataFrame:
    """doc, lost, added: how many cell addresses only the baseline or only the document has, where any."""
    a, b = baseline.select(*ADDRESS).distinct(), cells.select(*ADDRESS).distinct()
    each = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2))).groupBy(*ADDRESS).agg(F.sum("side").alias("sides"))
    return each.groupBy("doc").agg(F.count_if(F.col("sides") == 1).alias("lost"), F.count_if(F.col("sides") == 2).alias("added")).where("lost + added > 0")


def block_differences(blocks: DataFrame, baseline: DataFrame) -> DataFrame:
    """doc, block, missing, same_order of the baseline's blocks (doc, block, number, label): keys that the document's block lacks, and whether its numbers follow in the same order."""
    key = F.array_sort(F.collect_list(F.struct("number", "label")))
    a = baseline.groupBy("doc", "block").agg(key.alias("was"))
    b = blocks.groupBy("doc", "block").agg(key.alias("now"))
    both = a.join(b, ["doc", "block"], "left")
    missing = F.size(F.array_except("was", F.coalesce("now", F.slice("was", 1, 0))))
    return both.select("doc", "block", missing.cast("long").alias("missing"), F.coalesce(F.col("was.number") == F.col("now.number"), F.lit(False)).alias("same_order")).where("missing > 0 OR NOT same_order")


def best_grids(grids: DataFrame, baseline: DataFrame, least: float = 0.6, partitions: int | None = None) -> DataFrame:
    """doc, grid, match, score: each grid of the baseline (doc, grid, label) takes the unused grid of the document that has most of its labels, `least` of them at least.

    The share of the labels counts, and 0.001 more for as many labels; the best pair of a document is taken first, ties to the smaller numbers. A grid that none fits is lost: match is null.
    Documents are dealt over `partitions` (the session's number, where none is given) once, with all that their pairs are counted from.
    """
    sides = baseline.select("doc", "grid", "label", F.lit(True).alias("was")).unionByName(grids.select("doc", "grid", "label", F.lit(False).alias("was")))
    own = sides.where("doc is not null and grid is not null and label is not null").repartition(partitions or task_partitions(baseline), "doc")
    labels = own.groupBy("doc", "grid", "label").agg(F.max("was").alias("was"), F.max(~F.col("was")).alias("now"))
    whole = Window.partitionBy("doc", "grid")
    sized = labels.select("*", F.count_if("was").over(whole).alias("wanted"), F.count_if("now").over(whole).alias("had"))
    met = sized.groupBy("doc", "label").agg(F.collect_list(F.when(F.col("was"), F.struct("grid", "wanted"))).alias("a"), F.collect_list(F.when(F.col("now"), F.struct(F.col("grid").alias("match"), "had"))).alias("b"))
    # a grid with fewer labels than are asked for can't have them
    pairs = met.select("doc", "b", F.explode("a").alias("a")).select("doc", "a", F.explode("b").alias("b")).select("doc", "a.*", "b.*").where(F.col("had") >= least * F.col("wanted"))
    shared = pairs.groupBy("doc", "grid", "match", "wanted", "had").agg(F.count(F.lit(1)).alias("n"))
    score = F.col("n") / F.col("wanted") + F.when(F.col("wanted") == F.col("had"), 0.001).otherwise(0.0)
    fit = shared.where(F.col("n") >= least * F.col("wanted")).select("doc", "grid", "match", F.round(score, 6).alias("score"))

    def pair(part: pd.DataFrame) -> pd.DataFrame:
        rows, used, done = [], set(), set()
        for r in part.sort_values(["score", "grid", "match"], ascending=[False, True, True]).itertuples(index=False):
            if r.grid not in done and r.match not in used:
                done.add(r.grid)
                used.add(r.match)
                rows.append((r.doc, r.grid, r.match, r.score))
        return pd.DataFrame(rows, columns=["doc", "grid", "match", "score"])

    taken = fit.groupBy("doc").applyInPandas(pair, "doc long, grid long, match long, score double")
    return baseline.select("doc", "grid").distinct().join(taken, ["doc", "grid"], "left")


#: Tasks that a style's runs are dealt over.
STYLE_SALTS = 64


def unallowed_styles(runs: DataFrame, allowed: DataFrame) -> DataFrame:
    """kind, value, uses, places, sample of the runs (kind, value, at, text) whose (kind, value) is not allowed: the first five places, and the text at the first."""
    found = runs.join(allowed.select("kind", "value").distinct(), ["kind", "value"], "left_anti")
    # a frequent style is dealt over many tasks, each of which keeps its five least places
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("at", "text"), F.lit(STYLE_SALTS)))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("kind", "value", "salt").orderBy("at", "text")))
    firsts = lambda places: F.slice(F.array_sort(places), 1, 5)
    some = ranked.groupBy("kind", "value", "salt").agg(F.count(F.lit(1)).alias("n"), firsts(F.collect_list(F.when(F.col("r") <= 5, F.struct("at", "text")))).alias("places"))
    every = some.groupBy("kind", "value").agg(F.sum("n").alias("uses"), firsts(F.flatten(F.collect_list("places"))).alias("places"))
    return every.select("kind", "value", "uses", F.array_join(F.transform("places", lambda x: x["at"].cast("string")), ",").alias("places"), F.get("places", F.lit(0))["text"].alias("sample"))


def differing_fields(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """`key`, fields: the names of the fields that differ, nulls alike, of rows with equal keys."""
    a, b = left.select(key, *fields), right.select(key, *[F.col(f).alias(f"other_{f}") for f in fields])
    differ = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"other_{f}")), F.lit(f)) for f in fields])), ",")
    return a.join(b, key).select(key, differ.alias("fields")).where("fields <> ''")


def inside_envelopes(features: DataFrame, envelopes: DataFrame) -> DataFrame:
    """doc, inside: whether some envelope (entry, feature, most) has every feature (doc, feature, n) of a document, none above its most. Envelopes are a declared vocabulary."""
    kept = features.join(F.broadcast(envelopes), "feature").where("n <= most").groupBy("doc", "entry").agg(F.count(F.lit(1)).alias("fit"))
    all_ = features.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    return all_.join(kept, "doc", "left").groupBy("doc").agg(F.max(F.coalesce(F.col("fit") == F.col("n"), F.lit(False))).alias("inside"))


def declared_blanks(inventory: DataFrame, keys: DataFrame) -> DataFrame:
    """text, outcome of the strings of an inventory (text): consumed by a key (key, blank) that it holds or that holds it, keep if that key is declared blank, else unfilled.

    A key that claims two strings or more is refused and claims none. Keys are a declared vocabulary.
    """
    hit = inventory.select("text").distinct().join(F.broadcast(keys), F.col("text").contains(F.col("key")) | F.col("key").contains(F.col("text")))
    good = hit.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("key")
    claimed = hit.join(good, "key").groupBy("text").agg(F.max("blank").alias("blank"))
    return inventory.select("text").distinct().join(claimed, "text", "left").select("text", F.when(F.col("blank").isNull(), "unfilled").when(F.col("blank"), "keep").otherwise("consumed").alias("outcome"))


def unresolved_pointers(pointers: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """kind, pointers: how many of each kind (kind, id) lead nowhere. targets: for each kind a table of ids; pointers of other kinds lead nowhere."""
    known = None
    for kind, ids in targets.items():
        one = ids.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"))
        known = one if known is None else known.unionByName(one)
    return pointers.join(known.distinct(), ["kind", "id"], "left_anti").groupBy("kind").agg(F.count(F.lit(1)).alias("pointers"))


def packet_faults(markers: DataFrame) -> DataFrame:
    """doc, marker, number: references (is_header false) of a marker that heads something in the document, to a number that it doesn't head. `markers` has doc, marker, number, is_header."""
    heads = markers.where("is_header").select("doc", "marker", "number").distinct()
    refs = markers.where("NOT is_header").select("doc", "marker", "number").distinct()
    return refs.join(heads.select("doc", "marker").distinct(), ["doc", "marker"], "left_semi").join(heads, ["doc", "marker", "number"], "left_anti")


def vocabulary_votes(docs: DataFrame, vocabularies: dict[str, list[str]]) -> DataFrame:
    """doc_id, version, hits: the vocabulary whose words a text has most of, in one pass; version is null where there is none or two are equal."""
    words = T.tokens(F.coalesce("text", F.lit("")))
    held = lambda own: F.size(F.filter("w", lambda x: x.isin(own))).cast("long")
    counts = [held(own) for own in vocabularies.values()]
    rows = docs.select("doc_id", words.alias("w")).select("doc_id", *[c.alias(f"n_{i}") for i, c in enumerate(counts)])
    most = F.greatest(*[F.col(f"n_{i}") for i in range(len(counts))])
    winners = sum((F.col(f"n_{i}") == most).cast("int") for i in range(len(counts)))
    name = F.coalesce(*[F.when(F.col(f"n_{i}") == most, F.lit(v)) for i, v in enumerate(vocabularies)])
    return rows.select("doc_id", F.when((most > 0) & (winners == 1), name).alias("version"), most.alias("hits"))


def rule_families(features: DataFrame, families: dict[str, list[str]], least: int = 3) -> DataFrame:
    """doc, families: the families of features (doc, feature, n) that a document has `least` of, by name."""
    sums = [F.sum(F.when(F.col("feature").isin(own), F.col("n")).otherwise(0)).alias(name) for name, own in families.items()]
    rows = features.groupBy("doc").agg(*sums)
    return rows.select("doc", F.array_join(F.array_compact(F.array(*[F.when(F.col(n) >= least, F.lit(n)) for n in sorted(families)])), ",").alias("families"))


def section_orders(headings: DataFrame) -> DataFrame:
    """order, documents: how many documents have each sequence of headings (doc, position, heading)."""
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "heading"))), lambda x: x["heading"]), ">")
    return headings.groupBy("doc").agg(order.alias("order")).groupBy("order").agg(F.count(F.lit(1)).alias("documents"))


def ragged_tables(lines: DataFrame) -> DataFrame:
    """doc_id, line, cells, expected: rows of a table of bars whose cells aren't as many as in its first row; neighbouring lines that begin with a bar are a table. Lines with a column row are those of one row."""
    key = "row" if "row" in lines.columns else "doc_id"
    by = Window.partitionBy(key).orderBy("line")
    bars = lines.where(F.col("text").startswith("|")).withColumn("table", F.col("line") - F.row_number().over(by))
    cells = (F.size(F.split(F.rtrim("text", F.lit("| ")), r"\|")) - 1).cast("long")
    first = F.first("cells").over(Window.partitionBy(key, "table").orderBy("line"))
    return bars.withColumn("cells", cells).withColumn("expected", first).where("cells <> expected").select("doc_id", "line", "cells", "expected")


def gap_outliers(marks: DataFrame, factor: float = 1.8) -> DataFrame:
    """key, gaps, median, outliers: of the gaps above zero between neighbours (key, at) those larger than `factor` medians."""
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("key").orderBy("at"))
    gaps = marks.select("key", gap.alias("gap")).where("gap > 0")
    middle = gaps.groupBy("key").agg(F.median("gap").alias("median"))
    return gaps.join(middle, "key").groupBy("key", "median").agg(F.count(F.lit(1)).alias("gaps"), F.count_if(F.col("gap") > factor * F.col("median")).alias("outliers"))


def blanks_before(lines: DataFrame, anchor: Column) -> DataFrame:
    """doc_id, line, blanks: how many empty lines stand right before each line that is an anchor. Lines with a column row are those of one row."""
    by = Window.partitionBy("row" if "row" in lines.columns else "doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.trim("text") != "", F.col("line"))).over(by)
    return lines.withColumn("last", F.coalesce(last, F.lit(0))).where(anchor).select("doc_id", "line", (F.col("line") - F.col("last") - 1).cast("long").alias("blanks"))


def residue(docs: DataFrame, forbidden: list[str], allowed: str, width: int = 40) -> DataFrame:
    """doc_id, start, phrase, context: places of forbidden phrases, overlapping ones too, that lie in no span of the pattern `allowed`.

    start counts from 0. The context is the text around the place with line ends as spaces and `width` characters to each side.
    """
    rows = docs.where(F.lower("text").rlike("|".join(map(_quoted, forbidden)))).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.lower("text").alias("low"))
    # the number is used in two branches, so it is written once with its text
    rows = materialize(rows, "residue")
    by = Window.partitionBy("row", "phrase").orderBy("pos")
    before = F.coalesce(F.sum(F.length("piece")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = None
    for phrase in forbidden:
        # a text is cut before each place of the phrase, so every piece but the first begins where one does
        pieces = rows.where(F.col("low").contains(phrase)).select("row", "doc_id", "text", F.lit(phrase).alias("phrase"), F.col("low").startswith(phrase).alias("leads"), F.posexplode(F.split("low", f"(?={_quoted(phrase)})", -1)).alias("pos", "piece"))
        found = pieces if found is None else found.unionByName(pieces)
    found = found.withColumn("start", before).where((F.col("pos") > 0) | F.col("leads")).withColumn("end", F.col("start") + F.length("phrase"))
    inside = rows.select("row", F.lit("").alias("phrase"), F.posexplode(F.arrays_zip(F.split("low", allowed, -1).alias("between"), F.regexp_extract_all("low", F.lit(f"({allowed})"), F.lit(1)).alias("span"))).alias("pos", "m"))
    ends = F.sum(F.length("m.between") + F.coalesce(F.length("m.span"), F.lit(0))).over(by)
    inside = inside.withColumn("span_end", ends).where("m.span is not null").select("row", (F.col("span_end") - F.length("m.span")).alias("span_start"), "span_end")
    free = found.alias("f").join(inside.alias("i"), (F.col("f.row") == F.col("i.row")) & (F.col("span_start") <= F.col("start")) & (F.col("end") <= F.col("span_end")), "left_anti")
    begin = F.greatest(F.col("start") - width, F.lit(0))
    context = F.regexp_replace(F.substr(F.col("text"), (begin + 1).cast("int"), (F.col("end") + width - begin).cast("int")), "[\r\n]", " ")
    return free.select("doc_id", F.col("start").cast("long").alias("start"), "phrase", context.alias("context"))


def phrase_places(low: Column, phrases: list[str]) -> Column:
    """How many places of the phrases a text in lower case holds, overlapping ones too; null for a null text."""
    count = F.lit(0)
    for phrase in phrases:
        # where no end of a phrase begins it, its places don't overlap, and the pattern needn't look ahead at every character
        overlaps = any(phrase.startswith(phrase[-k:]) for k in range(1, len(phrase)))
        pattern = f"(?={_quoted(phrase)})" if overlaps else _quoted(phrase)
        count = count + F.when(low.contains(phrase), F.regexp_count(low, F.lit(pattern))).otherwise(0)
    return F.when(low.isNotNull(), count)


def _quoted(text: str) -> str:
    return re.sub(r"([.\[\]()|*+?^$\\{}])", r"\\\1", text)


def merged_settings(packs: DataFrame, floors: DataFrame) -> DataFrame:
    """key, value, values, floored of settings (key, value, priority): the value of the highest priority (ties: the larger value), how many values were given, and whether a floor (key, value) replaced it."""
    best = packs.groupBy("key").agg(F.max(F.struct("priority", "value")).alias("top"), F.count_distinct("value").alias("values"))
    joined = best.join(floors.select("key", F.col("value").alias("floor")), "key", "left")
    return joined.select("key", F.coalesce("floor", "top.value").alias("value"), "values", F.coalesce(F.col("floor") != F.col("top.value"), F.lit(False)).alias("floored"))


def ordered_union(lists: DataFrame) -> DataFrame:
    """key, items: the items (key, list, position, item) of all lists in order, each where it is first met."""
    first = lists.groupBy("key", "item").agg(F.min(F.struct("list", "position")).alias("at"))
    return first.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]), ",").alias("items"))


def certified_groups(docs: DataFrame) -> DataFrame:
    """features, train, holdout of documents (features, split, pass): groups of equal features that are in both splits and pass everywhere."""
    groups = docs.groupBy("features").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "holdout").alias("holdout"), F.min(F.col("pass")).alias("good"))
    return groups.where("train > 0 AND holdout > 0 AND good").select("features", "train", "holdout")


def version_fits(version: Column, clauses: list[tuple[str, tuple[int, int, int]]]) -> Column:
    """Whether a version major.minor.patch satisfies all clauses (operator, version); null where it is no version."""
    parts = F.split(version, r"\.")
    own = F.struct(*[F.get(parts, F.lit(i)).try_cast("int").alias(f"v{i}") for i in range(3)])
    known = version.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$")
    out = F.lit(True)
    for op, wanted in clauses:
        other = F.struct(*[F.lit(v).alias(f"v{i}") for i, v in enumerate(wanted)])
        out = out & {">=": own >= other, "<": own < other, ">": own > other, "<=": own <= other, "==": own == other, "!=": own != other}[op]
    return F.when(known, out)


def page_geometry(width_mm: Column, height_mm: Column) -> tuple[Column, Column]:
    """A width in units of 1/7200 inch, half up, and the class of a page whose sides are within 1.2 % of a known size."""
    # fixed values: sides in millimetres
    sizes = [("A4", 210.0, 297.0), ("Letter", 215.9, 279.4), ("Legal", 215.9, 355.6), ("B5", 182.0, 257.0)]
    near = lambda a, b: F.abs(a - F.lit(b)) <= 0.012 * F.greatest(a, F.lit(b))
    kind = F.coalesce(*[F.when((near(width_mm, w) & near(height_mm, h)) | (near(width_mm, h) & near(height_mm, w)), F.lit(n)) for n, w, h in sizes], F.lit("other"))
    return F.floor(width_mm * 7200 / 25.4 + 0.5).cast("long"), kind


def colour_class(hexadecimal: Column) -> tuple[Column, Column]:
    """Brightness (0 to 1) of a colour RRGGBB, and its class: near_red, blue or other; null for what is no colour."""
    part = lambda i: F.conv(F.substring(hexadecimal, i, 2), 16, 10).cast("int")
    r, g, b = part(1), part(3), part(5)
    valid = hexadecimal.rlike("^[0-9A-Fa-f]{6}$")
    kind = F.when((r >= 180) & (g <= 90) & (b <= 90), "near_red").when((b > 120) & (r < 100) & (g < 100), "blue").otherwise("other")
    return F.when(valid, F.round((r + g + b) / 3 / 255, 6)), F.when(valid, kind)
