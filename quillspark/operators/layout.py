"""Measured pages: lines and boxes with their places in points, and the verdicts on them. A page's lines stay together, so a page is the unit of every window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc", "page"]
# How a caption, an object's caption and a page number are written; factors of the rules.
CAPTION = r"(?i)^\s*(\[?그림|Fig)"
OBJECT_CAPTION = r"(?i)^\s*(표\s*\d|\[?그림\s*\d|Fig)"
FOOTER = r"^[-–—\s]*\d{1,3}[-–—\s]*$"
OUTLIER, HEADING, BOTTOM, FOOT, LINE_HEIGHT, BELOW = 1.8, 1.15, 0.12, 0.08, 12.0, 60.0
NARROW, WIDE = 0.45, 0.95


def spacing_outliers(lines: DataFrame, objects: DataFrame, height: float) -> DataFrame:
    """doc, page, at, gap, median: gaps between lines (doc, page, y0, y1, size, text) that are wide for their page and that nothing explains.

    Explained are gaps before a heading, at the foot of a page, before a page number, after a caption, across an image, and
    those that a table (objects: doc, page, kind, x0, x1, y0, y1) is within one line of. Pages of under three lines or two gaps have none; lines without a place are left out.
    """
    by = Window.partitionBy(*PAGE).orderBy("y0", "y1", "text", "size")
    nexts = [F.lead(c).over(by).alias(f"next_{c}") for c in ("y0", "size", "text")]
    rows = lines.where("y0 is not null and y1 is not null").select(*PAGE, "y0", "y1", "size", "text", *nexts).withColumn("gap", F.col("next_y0") - F.col("y1"))
    page = rows.groupBy(*PAGE).agg(
        F.median(F.when(F.col("gap") > 0, F.col("gap"))).alias("median"), F.count_if(F.col("gap") > 0).alias("gaps"), F.count(F.lit(1)).alias("lines"),
        F.median(F.when(F.col("size") != 0, F.col("size"))).alias("median_size"), F.coalesce(F.median(F.when(F.col("y1") - F.col("y0") > 1, F.col("y1") - F.col("y0"))), F.lit(LINE_HEIGHT)).alias("line_height"),
    ).where("lines >= 3 and gaps >= 2")
    heading = F.coalesce(F.col("next_size") > HEADING * F.col("median_size"), F.lit(False))
    footer = F.coalesce(F.col("next_text").rlike(FOOTER), F.lit(False)) & (F.col("next_y0") >= height * (1 - FOOT))
    caption = F.coalesce(F.col("text").rlike(OBJECT_CAPTION), F.lit(False))
    wide = rows.join(page, PAGE).where((F.col("gap") > OUTLIER * F.col("median")) & ~heading & ~footer & ~caption & (F.col("y1") < height * (1 - BOTTOM)))
    boxes = objects.select(F.col("doc").alias("d"), F.col("page").alias("p"), F.col("kind").alias("k"), F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    slack = F.when(F.col("k") == "table", F.col("line_height")).otherwise(0)
    near = (F.col("doc") == F.col("d")) & (F.col("page") == F.col("p")) & (F.col("top") - slack < F.col("next_y0")) & (F.col("bottom") + slack > F.col("y1"))
    return wide.join(boxes, near, "left_anti").select(*PAGE, F.round("y1", 1).alias("at"), F.round("gap", 1).alias("gap"), F.round("median", 1).alias("median"))


def figure_faults(figures: DataFrame, blocks: DataFrame, lines: DataFrame, width: float) -> DataFrame:
    """doc, page, figure, kind of figures (doc, page, figure, x0, x1, y0, y1): figure_width beside 0.45 to 0.95 of the column, figure_overlap with a block of text, caption_missing
    where neither the first line within 60 points below nor the last above is a caption."""
    shown = figures.select(*PAGE, "figure", "x0", "x1", "y0", "y1")
    share = (F.col("x1") - F.col("x0")) / width
    narrow = shown.where(~share.between(NARROW, WIDE)).select(*PAGE, "figure", F.lit("figure_width").alias("kind"))
    other = blocks.select(*PAGE, *[F.col(c).alias(f"b_{c}") for c in ("x0", "x1", "y0", "y1")])
    crossed = shown.join(other, PAGE).where("x0 < b_x1 and x1 > b_x0 and y0 < b_y1 and y1 > b_y0").select(*PAGE, "figure").distinct().withColumn("kind", F.lit("figure_overlap"))
    texts = lines.select(*PAGE, F.col("y0").alias("l0"), F.col("y1").alias("l1"), "text")
    near = shown.join(texts, PAGE, "left")
    is_below = F.col("l0").between(F.col("y1"), F.col("y1") + BELOW)
    first = F.min(F.when(is_below, F.struct("l0", "l1", "text"))).alias("below")
    last = F.max(F.when(F.col("l1") <= F.col("y0"), F.struct("l0", "l1", "text"))).alias("above")
    captioned = lambda c: F.coalesce(F.col(f"{c}.text").rlike(CAPTION), F.lit(False))
    bare = near.groupBy(*PAGE, "figure").agg(first, last).where(~captioned("below") & ~captioned("above")).select(*PAGE, "figure", F.lit("caption_missing").alias("kind"))
    return narrow.unionByName(crossed).unionByName(bare)


def header_blanks(cells: DataFrame) -> DataFrame:
    """doc, tab, col, label, pattern: empty cells of the first row of tables (doc, tab, row, col, text) that have a second.

    A row without any text is one fact (col null, blank_band); the only empty cell in front of a row with text below is a stub_head. The label is the nearest text to the left, else the one below.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    top = cells.groupBy("doc", "tab").agg(F.min("row").alias("top"), F.max("row").alias("end")).where("top < end")
    rows = cells.select("doc", "tab", "row", "col", text.alias("t")).join(top, ["doc", "tab"])
    head = rows.where("row = top").select("doc", "tab", "col", "t")
    below = rows.where("row = top + 1").select("doc", "tab", "col", F.col("t").alias("under"))
    by = Window.partitionBy("doc", "tab").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("doc", "tab")
    seen = head.select("doc", "tab", "col", "t", F.last(F.when(F.col("t") != "", F.col("t")), ignorenulls=True).over(by).alias("left"), F.count_if(F.col("t") != "").over(whole).alias("printed"), F.count_if(F.col("t") == "").over(whole).alias("empty"), F.min("col").over(whole).alias("first"))
    band = seen.where("printed = 0").select("doc", "tab", F.lit(None).cast("long").alias("col"), F.lit(None).cast("string").alias("label"), F.lit("blank_band").alias("pattern")).distinct()
    single = seen.where("printed > 0 and t = ''").join(below, ["doc", "tab", "col"], "left")
    stub = (F.col("empty") == 1) & (F.col("col") == F.col("first")) & (F.coalesce("under", F.lit("")) != "")
    label = F.coalesce("left", F.when(F.col("under") != "", F.col("under")))
    return band.unionByName(single.select("doc", "tab", "col", label.alias("label"), F.when(stub, "stub_head").alias("pattern")))


def layout_verdicts(pages: DataFrame, least: int, most: int, figures: int, white: float = 25.0, gap: float = 3.0) -> DataFrame:
    """doc, pages, worst_white, white_page, worst_gap, gap_page, state, needs of measured pages (doc, page, white, gap, figures).

    The last page may be white. The state is converged, else overfilled, underfilled or gappy; the needs stand in the order add_figures, expand, tighten, remove_gap.
    Of equal pages the first counts; a null measure is 0.
    """
    plain = pages.select("doc", "page", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("white", "gap", "figures")])
    # pages are numbered from the last one, so that a document is read once and never held
    numbered = plain.where("doc is not null").select("*", F.dense_rank().over(Window.partitionBy("doc").orderBy(F.desc_nulls_last("page"))).alias("from_last"))
    known = F.col("page").isNotNull()
    worst = lambda c, keep: F.max(F.when(keep & (F.col(c) > 0), F.struct(F.col(c).alias("value"), (-F.col("page")).alias("page"))))
    count = F.coalesce(F.max(F.when(known, F.col("from_last"))), F.lit(0)).cast("long")
    per = numbered.groupBy("doc").agg(count.alias("pages"), F.sum("figures").alias("shown"), worst("white", known & (F.col("from_last") > 1)).alias("w"), worst("gap", F.lit(True)).alias("g"))
    value = lambda c: F.coalesce(F.col(f"{c}.value"), F.lit(0.0))
    low, high, few = F.col("pages") < least, F.col("pages") > most, F.col("shown") < figures
    pale, gappy = value("w") > white, value("g") > gap
    state = F.when(~low & ~high & ~few & ~pale & ~gappy, "converged").when(high, "overfilled").when(low | few | pale, "underfilled").otherwise("gappy")
    needs = F.concat_ws(",", F.when(few, "add_figures"), F.when(low | pale, "expand"), F.when(high, "tighten"), F.when(gappy, "remove_gap"))
    place = lambda c: (-F.col(f"{c}.page")).cast("long")
    return per.select("doc", "pages", F.round(value("w"), 1).alias("worst_white"), place("w").alias("white_page"), value("g").alias("worst_gap"), place("g").alias("gap_page"), state.alias("state"), needs.alias("needs"))


def format_faults(styles: DataFrame, margins: DataFrame, height: int, spacing: int, expected: dict[str, int], bounds: tuple[int, int], slack: int = 2) -> DataFrame:
    """doc, code, severity, n of styles (doc, height, colour, bold, spacing) and margins (doc, pages, and the expected names).

    F1 no style of the body's height, F2 styles near red, F3 margins off by more than `slack`, F4 pages out of bounds, F5 the declared spacing isn't there, W3 bold styles.
    A document without margins breaks F3 once; a null colour isn't red.
    """
    near_red = F.coalesce(_near_red(F.col("colour")), F.lit(False))
    per = styles.groupBy("doc").agg(F.count_if(F.col("height") == height).alias("body"), F.count_if(near_red).alias("red"), F.count_if("bold").alias("bolds"), F.count_if(F.col("spacing") == spacing).alias("spaced"))
    off = sum(((F.abs(F.col(name) - v) > slack) | F.col(name).isNull()).cast("long") for name, v in expected.items())
    measured = margins.select("doc", F.greatest(off, F.lit(0)).alias("off"), (~F.col("pages").between(*bounds)).cast("long").alias("out"))
    rows = per.join(measured.groupBy("doc").agg(F.sum("off").alias("off"), F.max("out").alias("out")), "doc", "left")
    rules = [("F1", "HARD", (F.col("body") == 0).cast("long")), ("F2", "HARD", F.col("red")), ("F3", "HARD", F.coalesce("off", F.lit(1))), ("F4", "HARD", F.coalesce("out", F.lit(0))), ("F5", "HARD", (F.col("spaced") == 0).cast("long")), ("W3", "WARN", F.col("bolds"))]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), n.cast("long").alias("n")) for c, s, n in rules]))
    return rows.select("doc", each.alias("x")).where("x.n > 0").select("doc", "x.code", "x.severity", "x.n")


def _near_red(colour: Column) -> Column:
    """Of six hexadecimal digits: much red, little green and blue."""
    part = lambda at: F.conv(F.substring(colour, at, 2), 16, 10).cast("int")
    return colour.rlike("^[0-9A-Fa-f]{6}$") & (part(1) >= 180) & (part(3) <= 90) & (part(5) <= 90)


def conversion_faults(pairs: DataFrame) -> DataFrame:
    """key, code of the parts of a document before and after (key, before, after: arrays): content_differs if one has others or more, order_drift if only their order differs. A null array is empty."""
    a, b = (F.coalesce(c, F.array().cast("array<string>")) for c in ("before", "after"))
    code = F.when(F.array_sort(a) != F.array_sort(b), "content_differs").when(a != b, "order_drift")
    return pairs.select("key", code.alias("code")).where("code is not null")


def pointer_faults(stages: DataFrame, pointers: DataFrame, files: DataFrame, done_after: int = 6) -> DataFrame:
    """ws, code of workspaces: canonical_null_after_done where a stage from `done_after` on is done and the pointer is null, empty or a word for nothing; canonical_target_missing where it names no file of the workspace."""
    named = pointers.select("ws", F.when(~F.lower(F.trim("pointer")).isin("", "null", "none", "~"), F.trim("pointer")).alias("name"))
    done = stages.where((F.col("stage") >= done_after) & (F.col("status") == "done")).select("ws").distinct()
    empty = named.where("name is null").join(done, "ws", "left_semi").select("ws", F.lit("canonical_null_after_done").alias("code"))
    lost = named.where("name is not null").join(files, ["ws", "name"], "left_anti").select("ws", F.lit("canonical_target_missing").alias("code"))
    return empty.unionByName(lost)
