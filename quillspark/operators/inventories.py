"""What forms hold: slots, signatures, seals, consents, statutes, parties; and the gates that compare it with the blank form.

Seats (doc, tab, seat, text) are the cells of tables and, where tab is null, the paragraphs of a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .forms import squeezed

SEAT = ["doc", "tab", "seat"]
MARKED, UNMARKED = "[■☑●]", "[□☐]"
SIGNATURE = r"\((?:서명|인|sign)\)"
PLACEHOLDER = r"_{3,}|\.{5,}"
ARTICLE = "제[0-9]+조"
HEADER = r"\[Form[0-9]+\]"
DATE = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
GROUP = r"\(([^()]*)\)"
#: Layout that a value is read without.
FILLER = r"[_.:,·]|" + SIGNATURE


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _holds(text: Column, terms: list[str]) -> Column:
    """Whether a squeezed text holds any of the terms."""
    return F.exists(F.array(*[F.lit("".join(t.split())) for t in terms]), lambda t: F.contains(text, t))


def _joined(items: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(items)), ",")


def checkbox_cells(seats: DataFrame) -> DataFrame:
    """doc, tab, seat, marked, unmarked of the seats with slots to mark; a null text has none."""
    counts = seats.select(*SEAT, _count(F.coalesce("text", F.lit("")), MARKED).alias("marked"), _count(F.coalesce("text", F.lit("")), UNMARKED).alias("unmarked"))
    return counts.where("marked + unmarked > 0")


def signature_cells(seats: DataFrame) -> DataFrame:
    """doc, tab, seat, markers, n of the cells with places to sign (paragraphs have no address and are only counted, see measures)."""
    found = seats.where("tab is not null").select(*SEAT, _all(squeezed(F.col("text")), SIGNATURE).alias("m"))
    return found.where(F.size("m") > 0).select(*SEAT, _joined(F.col("m")).alias("markers"), F.size("m").cast("long").alias("n"))


def seal_cells(seats: DataFrame, labels: list[str]) -> DataFrame:
    """doc, tab, seat, labels, residue of the cells that name a seal: the residue is what stands there beside the labels."""
    own = ["".join(x.split()) for x in labels]
    text = squeezed(F.col("text"))
    rest = text
    for label in sorted(own, key=len, reverse=True):
        rest = F.replace(rest, F.lit(label), F.lit(""))
    found = F.filter(F.array(*map(F.lit, own)), lambda x: F.contains(text, x))
    return seats.where(F.col("tab").isNotNull() & _holds(text, labels)).select(*SEAT, _joined(found).alias("labels"), F.regexp_replace(rest, FILLER, "").alias("residue"))


def statute_counts(seats: DataFrame, terms: list[str]) -> DataFrame:
    """doc, term, n: how often a document cites each law, white space aside; a term across two seats isn't counted."""
    text = squeezed(F.col("text"))
    own = ["".join(t.split()) for t in terms]
    per = seats.groupBy("doc").agg(*[F.sum(F.size(F.split(text, _quoted(t), -1)) - 1).alias(f"n{i}") for i, t in enumerate(own)])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"n{i}").alias("n")) for i, t in enumerate(own)]))
    return per.select("doc", each.alias("x")).where("x.n > 0").select("doc", "x.term", "x.n")


def _quoted(term: str) -> str:
    return "\\Q" + term + "\\E"


def stencil_fragments(seats: DataFrame, least: int = 6) -> DataFrame:
    """doc, fragment: what a form itself prints between blanks and colons, squeezed, of `least` characters at least; each once a document."""
    pieces = seats.select("doc", F.explode(F.split(F.coalesce("text", F.lit("")), r"[ ]{3,}|_{2,}|[:：]", -1)).alias("p")).select("doc", squeezed(F.col("p")).alias("fragment"))
    return pieces.where(F.length("fragment") >= least).distinct()


def party_values(seats: DataFrame, labels: list[str]) -> DataFrame:
    """doc, tab, seat, position, label, value: the labels of a seat in order, each with what stands between it and the next, layout aside; of labels that overlap the longer counts."""
    pattern = "|".join(_quoted("".join(x.split())) for x in sorted(labels, key=lambda x: (-len("".join(x.split())), x)))
    text = squeezed(F.col("text"))
    rows = seats.select(*SEAT, _all(text, pattern).alias("labels"), F.slice(F.split(text, pattern, -1), 2, 1_000_000).alias("values"))
    each = rows.where(F.size("labels") > 0).select(*SEAT, F.posexplode(F.arrays_zip("labels", "values")).alias("position", "x"))
    return each.select(*SEAT, F.col("position").cast("long").alias("position"), F.col("x.labels").alias("label"), F.regexp_replace("x.values", FILLER, "").alias("value"))


def consent_groups(seats: DataFrame, labels: list[str], options: list[str], required: list[str], least: int = 2) -> DataFrame:
    """doc, tab, seat, position, options, basis, marked, required: groups of options in brackets whose table, or paragraph, has a label of consent.

    Two slots or more are counted as slots; else the parts between commas and slashes that are options as a whole. Groups of fewer than `least` are none.
    """
    text = squeezed(F.col("text"))
    own = seats.select(*SEAT, text.alias("s"), _holds(text, labels).alias("labelled"), _holds(text, required).alias("needs"))
    # only tables with a label are looked up, so a table without one costs nothing and a large one no more than its cells
    tables = own.where("tab is not null and (labelled or needs)").groupBy("doc", "tab").agg(F.max("labelled").alias("t_labelled"), F.max("needs").alias("t_needs"))
    both = own.join(tables, ["doc", "tab"], "left").select(*SEAT, "s", (F.col("labelled") | F.coalesce("t_labelled", F.lit(False))).alias("labelled"), (F.col("needs") | F.coalesce("t_needs", F.lit(False))).alias("required"))
    groups = both.where("labelled").select(*SEAT, "required", F.posexplode(_all(F.col("s"), GROUP, 1)).alias("position", "inner"))
    slots = groups.withColumns({"marked": _count(F.col("inner"), MARKED), "slots": _count(F.col("inner"), f"{MARKED}|{UNMARKED}")})
    tokens = F.transform(F.split("inner", "[,/]", -1), lambda x: F.regexp_replace(x, f"{MARKED}|{UNMARKED}", ""))
    named = F.size(F.filter(tokens, lambda x: x.isin(*["".join(o.split()) for o in options]))).cast("long")
    glyphs = F.col("slots") >= least
    found = slots.select(*SEAT, F.col("position").cast("long").alias("position"), F.when(glyphs, F.col("slots")).otherwise(named).alias("options"), F.when(glyphs, "glyphs").otherwise("tokens").alias("basis"), "marked", "required")
    return found.where(F.col("options") >= least)


def measures(seats: DataFrame, addressees: list[str], notes: str) -> DataFrame:
    """doc, counts of signatures, slots, marks, placeholders, addressees and notes, dated, sets of headers and articles: one aggregation of all seats."""
    text, plain = squeezed(F.col("text")), F.coalesce("text", F.lit(""))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    gathered = lambda pattern: F.array_sort(F.array_distinct(F.flatten(F.collect_set(_all(text, pattern)))))
    return seats.groupBy("doc").agg(
        total(_count(text, SIGNATURE)).alias("signatures"),
        total(_count(plain, f"{MARKED}|{UNMARKED}")).alias("slots"),
        total(_count(plain, MARKED)).alias("marks"),
        total(_count(plain, PLACEHOLDER)).alias("placeholders"),
        F.count_if(_holds(text, addressees)).alias("addressees"),
        F.count_if(F.contains(plain, F.lit(notes))).alias("notes"),
        F.max(text.rlike(DATE)).alias("dated"),
        gathered(HEADER).alias("headers"),
        gathered(ARTICLE).alias("articles"),
    )


def written_seats(seats: DataFrame, baseline: DataFrame, by_address: bool) -> DataFrame:
    """doc, written: seats of the blank form that hold another text now (by address), or whose text no seat of the document has (as a set)."""
    plain = lambda d, name: d.select(*SEAT, squeezed(F.col("text")).alias(name))
    if by_address:
        # a paragraph's tab is null on both sides
        a, b = plain(baseline, "was"), plain(seats, "now")
        changed = a.join(b.withColumnsRenamed({"doc": "d", "tab": "t", "seat": "s"}), F.col("doc").eqNullSafe(F.col("d")) & F.col("tab").eqNullSafe(F.col("t")) & F.col("seat").eqNullSafe(F.col("s")), "left").where(F.col("now").isNull() | (F.col("now") != F.col("was")))
    else:
        changed = plain(baseline, "was").join(seats.select("doc", squeezed(F.col("text")).alias("was")).distinct(), ["doc", "was"], "left_anti")
    return changed.groupBy("doc").agg(F.count(F.lit(1)).alias("written"))


#: The rules of a family of forms: (code, kind, measure). fewer: HARD if less than in the blank form; lost: HARD for each of a set that the
#: blank form has; new: HARD for each that it hasn't; left: what should be gone is HARD in a final, WARN in a draft, nothing in a blank document.
Rules = list[tuple[str, str, str]]
GRANT: Rules = [("signature_lost", "fewer", "signatures"), ("residue_left", "left", "placeholders")]
STAFF: Rules = [("signature_lost", "fewer", "signatures"), ("slot_lost", "fewer", "slots"), ("article_missing", "lost", "articles"), ("article_new", "new", "articles")]
PETITION: Rules = [("header_missing", "lost", "headers"), ("addressee_lost", "fewer", "addressees"), ("slot_lost", "fewer", "slots"), ("signature_lost", "fewer", "signatures"), ("glyphs_left", "left", "placeholders")]
OFFICIAL: Rules = [("header_missing", "lost", "headers"), ("notes_left", "left", "notes"), ("glyphs_left", "left", "placeholders")]


def states(now: DataFrame, written: DataFrame, mark: bool = False) -> DataFrame:
    """doc, state: blank (nothing written), draft (written, not dated) or final (dated). A mark in a slot counts as written if `mark`."""
    wrote = (F.coalesce("written", F.lit(0)) > 0) | ((F.col("marks") > 0) & F.lit(mark))
    return now.join(written, "doc", "left").select("doc", F.when(F.col("dated"), "final").when(wrote, "draft").otherwise("blank").alias("state"))


def official_states(now: DataFrame, written: DataFrame) -> DataFrame:
    """doc, state: final without a block of notes, else draft if anything is written, else blank."""
    return now.join(written, "doc", "left").select("doc", F.when(F.col("notes") == 0, "final").when(F.coalesce("written", F.lit(0)) > 0, "draft").otherwise("blank").alias("state"))


def gate(now: DataFrame, baseline: DataFrame, state: DataFrame, rules: Rules) -> DataFrame:
    """doc, state, code, severity, n of the rules that a document breaks, from the measures of both. Without a blank form its rules are skipped, with one row that says so."""
    was = baseline.withColumnsRenamed({c: f"was_{c}" for c in baseline.columns if c != "doc"}).withColumn("known", F.lit(True))
    rows = now.join(state, "doc").join(was, "doc", "left")
    known, final = F.coalesce("known", F.lit(False)), F.col("state") == "final"
    checks = [F.struct(F.lit("baseline_missing").alias("code"), F.lit("SKIPPED").alias("severity"), (~known).cast("long").alias("n"))]
    for code, kind, name in rules:
        a, b = F.col(name), F.col(f"was_{name}")
        broken: dict[str, Callable[[], Column]] = {
            "fewer": lambda a=a, b=b: F.greatest(b - a, F.lit(0)),
            "lost": lambda a=a, b=b: F.size(F.array_except(b, a)),
            "new": lambda a=a, b=b: F.size(F.array_except(a, b)),
            "left": lambda a=a: F.when(F.col("state") != "blank", a).otherwise(0),
        }
        n = broken[kind]().cast("long")
        if kind != "left":
            n = F.when(known, n).otherwise(0)
        severity = F.when(final | F.lit(kind != "left"), "HARD").otherwise("WARN")
        checks.append(F.struct(F.lit(code).alias("code"), severity.alias("severity"), n.alias("n")))
    return rows.select("doc", "state", F.explode(F.array(*checks)).alias("x")).where("x.n > 0").select("doc", "state", "x.code", "x.severity", "x.n")


def consent_findings(groups: DataFrame, baseline: DataFrame, state: DataFrame) -> DataFrame:
    """doc, state, code, severity, n: groups without a mark (HARD if required and final, else WARN, none in a blank document), and groups and options fewer than in the blank form."""
    open_ = groups.where("basis = 'glyphs' and marked = 0").join(state.where("state <> 'blank'"), "doc")
    severity = F.when(F.col("required") & (F.col("state") == "final"), "HARD").otherwise("WARN")
    unmarked = open_.groupBy("doc", "state", severity.alias("severity")).agg(F.count(F.lit(1)).alias("n")).select("doc", "state", F.lit("consent_unmarked").alias("code"), "severity", "n")
    count = lambda d: d.groupBy("doc").agg(F.count(F.lit(1)).alias("groups"), F.sum("options").alias("options"))
    both = state.join(count(baseline).withColumnsRenamed({"groups": "g", "options": "o"}), "doc").join(count(groups), "doc", "left")
    fewer = both.select("doc", "state", F.explode(F.array(*[F.struct(F.lit(code).alias("code"), F.lit("HARD").alias("severity"), (F.col(b) - F.coalesce(a, F.lit(0))).alias("n")) for code, a, b in (("consent_group_lost", "groups", "g"), ("consent_option_lost", "options", "o"))])).alias("x"))
    return unmarked.unionByName(fewer.where("x.n > 0").select("doc", "state", "x.code", "x.severity", "x.n"))


def seal_findings(seals: DataFrame, baseline: DataFrame) -> DataFrame:
    """doc, code, severity, n: seal cells of the blank form that are gone, and those with another residue than the blank form's."""
    was = baseline.select(*SEAT, F.col("residue").alias("was"))
    both = was.join(seals, SEAT, "left")
    code = F.when(F.col("residue").isNull(), "seal_removed").when(F.col("residue") != F.col("was"), "seal_written")
    return both.select("doc", code.alias("code")).where("code is not null").groupBy("doc", "code").agg(F.count(F.lit(1)).alias("n")).select("doc", "code", F.lit("HARD").alias("severity"), "n")


def party_findings(values: DataFrame, first: str, second: str, state: DataFrame) -> DataFrame:
    """doc, code, severity, n: seats in which exactly one of two parties is filled; HARD in a final, else WARN."""
    pairs = values.groupBy(*SEAT).agg(*[F.max(F.when(F.col("label") == x, F.col("value") != "")).alias(name) for x, name in ((first, "a"), (second, "b"))]).where("a <> b")
    found = pairs.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).join(state, "doc")
    return found.select("doc", F.lit("party_one_sided").alias("code"), F.when(F.col("state") == "final", "HARD").otherwise("WARN").alias("severity"), "n")
