"""Numbers, claims, citations and references in texts."""

from __future__ import annotations

import difflib
import json
import math
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from ..functions import text as T
from ..functions.units import QUANTITIES, UNITS
from ..plans.shared import materialize, task_partitions
from .relational import backed
from .text import keyed_lines, line_rows

#: What stands between a number and the one before it, in which its subject is looked for, the number, and the word that follows it, which is only looked at.
NUMBER = r"([^0-9]*)([0-9][0-9,]*(?:\.[0-9]+)?)(?= ?([A-Za-zµ°%]*))"
#: The same from where the number before ends only, so that what follows a line's last number isn't searched from each of its characters.
NEXT_NUMBER = rf"\G{NUMBER}"
SUBJECT = r"([A-Za-z][A-Za-z ]*?) *(?:=|:| is| was| were) *$"
#: What every number with a subject stands behind, and a test of it that fails sooner.
TOLD, NEARLY_TOLD = r"[A-Za-z] *(?:=|:| is| was| were) *[0-9]", "[=:se] *[0-9]"
REFERENCE = r"(?i)^ *(?:\[|fig(?:ure)?\.?|table|page|section|p\.) *$"
BINDING = r"^ *([A-Za-z][A-Za-z _]*?) *= *(-?[0-9][0-9,]*(?:\.[0-9]+)?) *([A-Za-zµ°%]*) *$"
HEADING = r"^#{1,6} "
#: What every heading of references holds.
REFERENCES = r"(?i)# *(?:references|bibliography|참고문헌)"
REFERENCE_HEADING = r"(?i)^#{1,6} *(?:references|bibliography|참고문헌) *$"
TOLERANCE = 0.01
#: N-grams of prior texts, at most, that are sent to all tasks; beyond, both sides are shuffled.
BROADCAST_GRAMS = 1 << 20


def _units(like: DataFrame) -> DataFrame:
    return F.broadcast(like.sparkSession.createDataFrame(UNITS, "alias string, unit string, dimension string, scale double"))


def may_tell(text: Column) -> Column:
    """Whether a text or a line may hold a claim with a subject; few do."""
    return text.rlike(NEARLY_TOLD) & text.rlike(TOLD)


def numeric_claims(docs: DataFrame, told: bool = False) -> DataFrame:
    """doc_id, line, ord, raw, value, unit, dimension, canonical, subject, ignored, candidate: every number of every line, or with `told` of every line that may tell a number's subject.

    ignored: a year without unit, a number of a heading, a list marker, or one that names a figure, table, page or section. candidate: not
    ignored, and with a unit or a decimal of two significant digits. Units are looked up as written; canonical is the value in the base unit.
    """
    sought = may_tell(F.col("text")) if told else F.col("text").rlike("[0-9]")
    lines = line_rows(docs.where(sought) if told else docs).where(sought)
    group = lambda i: F.regexp_extract_all("text", F.lit(NEXT_NUMBER), F.lit(i))
    lines = lines.select("doc_id", "line", "text", group(1).alias("before"), group(2).alias("raw"), group(3).alias("after"))
    # the unit of the number before is no part of a subject, any other word may be
    known = F.coalesce(F.get("after", F.col("ord") - 1).isin([u[0] for u in UNITS]), F.lit(False))
    before = F.when(known, F.regexp_replace("m.before", "^ ?[A-Za-zµ°%]*", "")).otherwise(F.col("m.before"))
    each = lines.select("doc_id", "line", "text", "after", F.posexplode(F.arrays_zip("before", "raw", "after")).alias("ord", "m"))
    each = each.select("doc_id", "line", "text", (F.col("ord") + 1).alias("ord"), before.alias("before"), "m.raw", F.col("m.after").alias("alias")).where(~F.col("before").rlike("[A-Za-z_.]$"))
    value = T.number(F.col("raw"))
    found = each.join(_units(docs), "alias", "left").withColumn("value", value).where("value is not null")
    whole = ~F.col("raw").contains(".")
    marker = (F.col("ord") == 1) & F.col("text").rlike(r"^ *[0-9]+[.)] ")
    ignored = (whole & F.col("unit").isNull() & F.col("value").between(1800, 2199)) | F.col("text").rlike(HEADING) | marker | F.regexp_extract("before", r"([^ ]+) *$", 1).rlike(REFERENCE)
    digits = F.length(F.regexp_replace(F.regexp_replace("raw", "[.,]", ""), "^0+", ""))
    subject = F.nullif(F.lower(F.regexp_replace(F.regexp_extract(F.regexp_extract("before", r"([^;,.!?。]*)$", 1), SUBJECT, 1), "(?i)^(?:the|an|a|and) +", "")), F.lit(""))
    subject = F.regexp_replace(subject, "^(?:the|an|a) +", "")
    return found.select("doc_id", "line", "ord", "raw", "value", "unit", "dimension", (F.col("value") * F.col("scale")).alias("canonical"), subject.alias("subject"), ignored.alias("ignored"), (~ignored & (F.col("unit").isNotNull() | (~whole & (digits >= 2)))).alias("candidate"))


def unit_mismatches(claims: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, subject, line, other_line, dimension, other: two claims of one subject and value in different dimensions."""
    side = claims.where("candidate AND subject is not null AND dimension is not null").select("doc_id", "subject", "line", "ord", "value", "dimension")
    a, b = side.alias("a"), side.alias("b")
    later = (F.col("a.line") < F.col("b.line")) | ((F.col("a.line") == F.col("b.line")) & (F.col("a.ord") < F.col("b.ord")))
    pairs = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.subject") == F.col("b.subject")) & later & (F.col("a.dimension") != F.col("b.dimension")) & T.close(F.col("a.value"), F.col("b.value"), tolerance))
    return pairs.select("a.doc_id", "a.subject", "a.line", F.col("b.line").alias("other_line"), "a.dimension", F.col("b.dimension").alias("other"))


def impossible_dimensions(claims: DataFrame) -> DataFrame:
    """doc_id, line, subject, dimension, expected: claims whose subject ends with a quantity of another dimension."""
    expected = F.coalesce(*[F.when(F.col("subject").rlike(rf"(?:^| ){word}$"), F.lit(dimension)) for word, dimension in QUANTITIES])
    return claims.where("candidate AND dimension is not null").withColumn("expected", expected).where("expected <> dimension").select("doc_id", "line", "subject", "dimension", "expected")


def bindings(docs: DataFrame) -> DataFrame:
    """doc_id, line, name, value, unit (empty without one): lines that are a binding and nothing else."""
    group = lambda i: F.regexp_extract("text", BINDING, i)
    return line_rows(docs).where(F.col("text").rlike(BINDING)).select("doc_id", "line", F.lower(group(1)).alias("name"), T.number(group(2)).alias("value"), group(3).alias("unit")).where("value is not null")


def binding_conflicts(current: DataFrame, prior: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """name, unit, now, before, difference: per name the worst pair of bindings of the same unit that differ by more than the tolerance."""
    now = current.select("name", "unit", F.col("value").alias("now"))
    before = prior.groupBy("name", "unit").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    both = now.join(before, ["name", "unit"]).select("name", "unit", "now", F.explode(F.array("least", "most")).alias("before"))
    both = both.withColumn("difference", F.abs(F.col("now") - F.col("before")) / F.greatest(F.abs("now"), F.abs("before"))).where(F.col("difference") > tolerance)
    worst = both.groupBy("name").agg(F.max(F.struct("difference", "now", "before", "unit")).alias("w"))
    return worst.select("name", "w.unit", "w.now", "w.before", F.round("w.difference", 6).alias("difference"))


def summary_support(summary: DataFrame, claims: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """subject, unit, value, verdict of each claim of a summary (subject, unit, value): supported, conflict, ambiguous, missing.

    A key (subject, unit) is ambiguous if its claims have values that aren't one; a claim without subject is supported by any claim of its unit and value.
    """
    known = claims.where("candidate AND unit is not null").select("subject", "unit", "canonical")
    keyed = known.where("subject is not null").groupBy("subject", "unit").agg(F.min("canonical").alias("least"), F.max("canonical").alias("most"))
    s = summary.select("subject", "unit", "value")
    same = lambda a, b: T.close(F.col(a), F.col(b), tolerance)
    with_subject = s.where("subject is not null").join(keyed, ["subject", "unit"], "left")
    verdict = F.when(F.col("least").isNull(), "missing").when(~same("least", "most"), "ambiguous").when(same("value", "least") | same("value", "most"), "supported").otherwise("conflict")
    alone = s.where("subject is null").select("unit", "value")
    hit = alone.join(known.select("unit", "canonical").distinct(), "unit").where(same("value", "canonical")).select("unit", "value").distinct().withColumn("hit", F.lit(True))
    rest = alone.join(hit, ["unit", "value"], "left").select(F.lit(None).cast("string").alias("subject"), "unit", "value", F.when(F.col("hit"), "supported").otherwise("missing").alias("verdict"))
    return with_subject.select("subject", "unit", "value", verdict.alias("verdict")).unionByName(rest)


@F.pandas_udf(ArrayType(DoubleType()))
def numeric_leaves(texts: pd.Series) -> pd.Series:
    """Every finite number at any depth of a JSON text, no booleans; empty for null and for what is no JSON."""

    def walk(x: object) -> list[float]:
        if isinstance(x, bool):
            return []
        if isinstance(x, (int, float)):
            return [float(x)] if abs(x) < 1e308 and math.isfinite(x) else []
        return [y for v in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else []) for y in walk(v)]

    def one(text: str | None) -> list[float]:
        try:
            return walk(json.loads(text or ""))
        except (ValueError, RecursionError):
            return []

    return texts.map(one)


def backed_claims(claims: DataFrame, results: DataFrame, constants: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """doc_id, line, ord, value, backed_by: result, constant or nothing, of each candidate.

    A result (result) backs a value within the tolerance; a constant (value, unit) backs one that is equal, if it has no unit or the same.
    """
    own = claims.where("candidate").select("doc_id", "line", "ord", "value", "unit")
    hits = backed(own.select(F.col("value").alias("id"), "value").distinct(), results, tolerance).where("backed").select("value", F.lit(True).alias("result"))
    fixed = constants.groupBy("value").agg(F.collect_set("unit").alias("units"), F.max(F.col("unit").isNull()).alias("any"))
    joined = own.join(hits, "value", "left").join(F.broadcast(fixed), "value", "left")
    constant = F.coalesce(F.col("any") | F.array_contains("units", F.col("unit")), F.lit(False))
    return joined.select("doc_id", "line", "ord", "value", F.when(F.col("result"), "result").when(constant, "constant").otherwise("nothing").alias("backed_by"))


def sections(docs: DataFrame) -> DataFrame:
    """row, doc_id, line, text, heading (the last heading's line, null before any), reference (whether that heading begins references); rows of one doc_id are kept apart."""
    by = Window.partitionBy("row").orderBy("line")
    head = F.when(F.col("text").rlike(HEADING), F.struct("line", F.col("text").rlike(REFERENCE_HEADING).alias("reference")))
    rows = keyed_lines(docs).withColumn("head", F.last(head, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("row", "doc_id", "line", "text", F.col("head.line").alias("heading"), F.coalesce("head.reference", F.lit(False)).alias("reference"))


def section_scopes(docs: DataFrame) -> DataFrame:
    """doc_id, scope, lines, chars: how much stands under each class of heading; before any it is body. Rows of one doc_id are summed, each by its own headings."""
    rows = keyed_lines(docs)
    name = F.lower("text")
    kind = F.when(name.rlike("summary|abstract"), "summary").when(name.rlike("method"), "method").when(name.rlike("result"), "results").when(name.rlike("reference|참고문헌"), "references").otherwise("body")
    by = Window.partitionBy("row").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    scoped = rows.withColumn("scope", F.coalesce(F.last(F.when(F.col("text").rlike(HEADING), kind), ignorenulls=True).over(by), F.lit("body")))
    return scoped.where(~F.col("text").rlike(HEADING)).groupBy("doc_id", "scope").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).cast("long").alias("chars"))


def without_references(docs: DataFrame) -> DataFrame:
    """doc_id, lines, blanked, body_hash: each row's text with every line of a reference section emptied, as a digest."""
    body = sections(docs).withColumn("own", F.when(F.col("reference"), "").otherwise(F.col("text")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "own"))), lambda x: x["own"]), "\n")
    return body.groupBy("row", "doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("reference")).alias("blanked"), F.sha2(text, 256).alias("body_hash")).drop("row")


def reference_entries(docs: DataFrame, now: int = 2026) -> DataFrame:
    """doc_id, entry, author, year, title, doi, doi_slug, isbn, url, future: the entries of the first reference section.

    An indented line, or one of identifiers alone, goes on with the entry before it. future: the year is after `now`.
    """
    rows = sections(docs).where("reference")
    first = Window.partitionBy("row")
    rows = rows.withColumn("first", F.min("heading").over(first)).where((F.col("heading") == F.col("first")) & (F.col("line") > F.col("heading")) & (F.trim("text") != ""))
    more = F.col("text").rlike(r"^ +") | F.col("text").rlike(r"(?i)^(?:doi:|https?://|isbn )\S+ *$")
    by = Window.partitionBy("row").orderBy("line")
    rows = rows.withColumn("entry", F.sum(F.when(more, 0).otherwise(1)).over(by))
    merged = rows.groupBy("row", "doc_id", "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("x"))
    part = lambda pattern: F.nullif(F.regexp_extract("x", pattern, 1), F.lit(""))
    year = part(r"\(([0-9]{4})[a-z]?\)").cast("int")
    doi = F.lower(part(r"(10\.[0-9]{4,9}/[^ ]+)"))
    isbn = F.regexp_replace(part(r"(?i)isbn:? *([0-9][0-9 -]{8,16}[0-9Xx])"), "[ -]", "")
    valid = F.when(F.length(isbn) == 10, T.valid_isbn10(isbn)).when(F.length(isbn) == 13, T.valid_isbn13(isbn)).otherwise(F.lit(False))
    return merged.select(
        "doc_id", F.col("entry").cast("long").alias("entry"), part(r"^([^,.(]+),").alias("author"), year.alias("year"), part(r"\([0-9]{4}[a-z]?\)\. *([^.]+)\.").alias("title"), doi.alias("doi"),
        F.regexp_replace(doi, "[^a-z0-9.-]", "_").alias("doi_slug"), F.when(valid, isbn).alias("isbn"), T.canonical_url(part(r"(https?://[^ ]+)")).alias("url"), F.coalesce(year > now, F.lit(False)).alias("future"),
    )


#: The forms of a citation, the earlier first where two begin at one place and are as long.
CITATIONS = [("pandoc", r"\[@[^\]]+\]"), ("parenthetical", r"\([A-Z][^()]*, ?[0-9]{4}[a-z]?\)"), ("narrative", r"[A-Z][a-z]+ \([0-9]{4}[a-z]?\)"), ("numeric", r"\[[0-9]+(?:[-,] ?[0-9]+)*\]")]


def citation_markers(docs: DataFrame) -> DataFrame:
    """doc_id, line, start, kind, marker: citations of every line, in order and without overlaps: the earlier and then the longer wins."""
    lines = line_rows(docs).where(F.col("text").rlike("[0-9]"))

    def places(kind: str, pattern: str) -> Column:
        found, between = F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)), F.split("text", pattern, -1)
        # a match begins after all that stands between and the matches before it
        start = lambda i: F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda a, x: a + F.length(x))
        return F.transform(found, lambda m, i: F.struct(start(i).alias("start"), (-F.length(m)).alias("short"), F.lit(kind).alias("kind"), m.alias("marker")))

    every = F.array_sort(F.concat(*[places(k, p) for k, p in CITATIONS]))
    some = F.col("text").rlike("|".join(p for _, p in CITATIONS))
    rows = lines.where(some).select("doc_id", "line", every.alias("every"))
    empty = F.struct(F.lit(0).alias("end"), F.slice("every", 1, 0).alias("kept"))
    kept = F.aggregate("every", empty, lambda a, x: F.when(x["start"] >= a["end"], F.struct((x["start"] - x["short"]).alias("end"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a))["kept"]
    return rows.select("doc_id", "line", F.explode(kept).alias("c")).select("doc_id", "line", "c.start", "c.kind", "c.marker")


NARRATIVE = r"([A-Z][a-z]+) \(([0-9]{4})[a-z]?\)"


def may_cite(text: Column) -> Column:
    """Whether a text may hold a narrative citation."""
    return text.contains(" (") & text.rlike(NARRATIVE)


def may_list(text: Column) -> Column:
    """Whether a text may hold references."""
    return text.contains("#") & text.rlike(REFERENCES)


def unlisted_citations(docs: DataFrame) -> DataFrame:
    """doc_id, surname, year, uses: narrative citations whose surname begins no reference of their text. Only texts that may cite are cut into sections, and only texts that may list references into entries."""
    group = lambda i: F.regexp_extract_all("text", F.lit(NARRATIVE), F.lit(i))
    body = sections(docs.where(may_cite(F.col("text")))).where("NOT reference")
    cited = body.select("doc_id", F.explode(F.arrays_zip(group(1).alias("surname"), group(2).alias("year"))).alias("c")).groupBy("doc_id", "c.surname", F.col("c.year").cast("int").alias("year")).agg(F.count(F.lit(1)).alias("uses"))
    return cited.join(reference_entries(docs.where(may_list(F.col("text")))).select("doc_id", F.col("author").alias("surname")), ["doc_id", "surname"], "left_anti")


def source_tokens(source: Column) -> Column:
    """The typed names of a source: id, and where it has them DOI, ISBN and URL."""
    low = F.lower(F.trim(source))
    doi, isbn = F.regexp_extract(low, r"(10\.[0-9]{4,9}/[^ ]+)", 1), F.regexp_replace(F.regexp_extract(low, r"isbn:? *([0-9][0-9x -]{8,16})", 1), "[ -]", "")
    url = T.canonical_url(F.regexp_extract(source, r"(https?://[^ ]+)", 1))
    return F.array_compact(F.array(F.concat(F.lit("id:"), low), F.when(doi != "", F.concat(F.lit("doi:"), doi)), F.when(isbn != "", F.concat(F.lit("isbn:"), isbn)), F.concat(F.lit("url:"), url)))


def resolved_sources(cited: DataFrame, available: DataFrame) -> DataFrame:
    """source, resolved: whether a cited source shares a typed name with an available one (both: source)."""
    names = lambda d: d.select("source").distinct().select("source", F.explode(source_tokens(F.col("source"))).alias("name"))
    known = names(available).select("name").distinct()
    return names(cited).join(known.withColumn("hit", F.lit(True)), "name", "left").groupBy("source").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("resolved"))


def traced_claims(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """id, traced: whether a ledger entry (value, assertion) of a claim (id, value, text) has its value and holds its text, or is held in it."""
    plain = lambda c: T.collapse(T.fold(F.col(c)))
    entries = ledger.select("value", plain("assertion").alias("assertion")).distinct()
    pairs = claims.select("id", "value", plain("text").alias("line")).join(entries, "value").where(F.col("assertion").contains(F.col("line")) | F.col("line").contains(F.col("assertion")))
    return claims.select("id").distinct().join(pairs.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("traced"))


@F.pandas_udf(DoubleType())
def edit_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts; null where one is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(left, right, strict=True)], dtype="float64")


def bounded_ratio(least: float) -> Callable[[Column, Column, Column], Column]:
    """edit_ratio of two texts; null where their characters alone keep it below `least`, unless it is wanted anyway (third column)."""

    @F.pandas_udf(DoubleType())
    def ratio(left: pd.Series, right: pd.Series, wanted: pd.Series) -> pd.Series:
        def one(x: str, y: str, want: bool) -> float | None:
            match = difflib.SequenceMatcher(None, x, y, autojunk=False)
            return match.ratio() if want or match.quick_ratio() >= least else None

        return pd.Series([one(*row) for row in zip(left, right, wanted, strict=True)], dtype="float64")

    return ratio


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Unicode normal form C; null stays."""
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """Unicode normal form KC; null stays."""
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def title_matches(cited: DataFrame, known: DataFrame, ratio: float = 0.92, jaccard: float = 0.8, least: int = 3) -> DataFrame:
    """kind, id, other_id, ratio: titles (id, title) that are one by edit ratio, or by Jaccard with all tokens of the shorter in order.

    Equal titles are one class, named by its smallest id, so copies don't multiply. kind is match (of a cited class, id, with a known one, other_id),
    or cited or known (a row's id and its class; ratio null): a cited row matches the known rows of all classes that its own class matches.
    Pairs come from equal rare tokens: of a title's tokens the three of fewest titles, of which two alike titles share one.
    """
    classes = lambda d, name: d.where("id is not null and title is not null").groupBy(F.col("title").alias(name)).agg(F.min("id").alias(f"{name}_id"), F.count(F.lit(1)).alias("n"))
    a, b = classes(cited, "cited"), classes(known, "known")
    each = lambda d, name: d.select("*", F.explode(F.array_distinct(T.tokens(F.col(name)))).alias("token"))
    counts = each(b, "known").groupBy("token").agg(F.sum("n").alias("uses"))

    def rare(d: DataFrame, name: str) -> DataFrame:
        ranked = each(d, name).join(counts, "token").groupBy(f"{name}_id", name).agg(F.slice(F.array_sort(F.collect_list(F.struct("uses", "token"))), 1, 3).alias("few"))
        return ranked.select(f"{name}_id", name, F.explode("few.token").alias("token"))

    met = rare(a, "cited").join(rare(b, "known"), "token").select("cited_id", "cited", "known_id", "known").distinct()
    pairs = met.select("*", T.tokens(F.col("cited")).alias("cited_tokens"), T.tokens(F.col("known")).alias("known_tokens"))
    both, either = F.size(F.array_intersect("cited_tokens", "known_tokens")), F.size(F.array_union("cited_tokens", "known_tokens"))
    shorter = F.when(F.size("cited_tokens") <= F.size("known_tokens"), T.in_order(F.col("cited_tokens"), F.col("known_tokens"))).otherwise(T.in_order(F.col("known_tokens"), F.col("cited_tokens")))
    fits = (F.least(F.size("cited_tokens"), F.size("known_tokens")) >= least) & (both >= jaccard * either) & shorter
    # a ratio is at most what the lengths allow, whatever the titles hold; one place of rounding is left
    low = (F.lower("cited"), F.lower("known"))
    most = 2 * F.least(*map(F.length, low)) / (F.length(low[0]) + F.length(low[1]))
    scored = pairs.select("cited_id", "known_id", "cited", "known", fits.alias("fits")).where(F.col("fits") | (most >= ratio - 1e-6))
    score = F.round(bounded_ratio(ratio - 1e-6)(*low, F.col("fits")), 6)
    # few bytes and much work: they would be put into few tasks
    scored = scored.repartition(task_partitions(scored)).select(F.lit("match").alias("kind"), F.col("cited_id").alias("id"), F.col("known_id").alias("other_id"), score.alias("ratio"), "fits")
    found = scored.where((F.col("ratio") >= ratio) | F.col("fits")).drop("fits")
    members = lambda d, kind: d.where("id is not null and title is not null").select(F.lit(kind).alias("kind"), "id", F.min("id").over(Window.partitionBy("title")).alias("other_id"), F.lit(None).cast("double").alias("ratio"))
    return found.unionByName(members(cited, "cited")).unionByName(members(known, "known"))


def longest_runs(docs: DataFrame, prior: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, item_id, run: the longest run of tokens that a text shares with an item, where it has `least` tokens.

    Runs of `least` are hashed and joined by equality; neighbours on one diagonal of a pair make longer ones.
    """
    def grams(d: DataFrame, key: str, at: str) -> DataFrame:
        hashes = d.select(key, T.hashed(T.tokens(F.col("text"))).alias("h")).where(F.size("h") >= least)
        return hashes.select(key, F.posexplode(T.gram_hashes(F.col("h"), least)).alias(at, "gram"))

    known = materialize(grams(prior, "item_id", "j"), "prior-grams")
    # few prior n-grams go to the texts, whose other n-grams are then never shuffled
    if known.count() <= BROADCAST_GRAMS:
        known = F.broadcast(known)
    met = grams(docs, "doc_id", "i").join(known, "gram").select("doc_id", "item_id", "i", (F.col("i") - F.col("j")).alias("diagonal")).distinct()
    island = F.col("i") - F.row_number().over(Window.partitionBy("doc_id", "item_id", "diagonal").orderBy("i"))
    runs = met.withColumn("island", island).groupBy("doc_id", "item_id", "diagonal", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("doc_id", "item_id").agg((F.max("n") + least - 1).alias("run"))
