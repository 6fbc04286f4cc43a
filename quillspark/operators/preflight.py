"""Preflight of marked-up texts: nine declared checkers in one scan.

A checker is an array expression over the parts of a text that all of them share: its lines by section, its bindings, its decimals. The parts are
columns of a lower projection, so each is computed once, and the findings of all checkers come out as one array, without a join or a
shuffle. A text is judged within its row, whatever its id.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Headings, and what makes a section a summary or a list of references.
HEADING, SUMMARY, REFERENCES = r"^#{1,6} ", "summary|abstract", "reference|bibliography|참고문헌"
BINDING = r"^ *([A-Za-z][A-Za-z _]*?) *= *(-?[0-9]+(?:\.[0-9]+)?) *([A-Za-z%]*) *$"
DECIMAL, CITATION, MARKER, FIGURE = r"[0-9]+\.[0-9]+", r"\[([0-9]{1,3})\]", r"\[@([a-z0-9]+)\]", r"\[\[FIG [^\]]*\]\]"
PLACEHOLDER = r"(?i)\b(?:todo|tbd|fixme)\b|fill in here"
PHRASES = ["in order to", "very very", "it should be noted"]
TOLERANCE, NOW = 1e-3, 2026

_FINDING = "array<struct<checker: string, severity: string, line: int, detail: string>>"
_NONE = "array<struct<line: int, text: string>>"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def parts(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with a text (doc_id, text), and the shared parts: body, summary, references (lines of each kind of section as line and text, blank and heading lines apart), has_references, bindings (line, name, value, unit), decimals of the body, of the summary (line, raw, value)."""
    rows = docs.where("text is not null").select("doc_id", "text", T.lines(F.col("text")).alias("lines"))
    begins = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(HEADING), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("begins", F.concat(F.array(F.lit(-1)), begins))

    def section(at: Column, i: Column) -> Column:
        name = F.lower(F.when(at >= 0, F.get("lines", at)).otherwise(""))
        kind = F.when(name.rlike(REFERENCES), "references").when(name.rlike(SUMMARY), "summary").otherwise("body")
        own = F.slice("lines", at + 2, F.coalesce(F.get("begins", i + 1), F.size("lines")) - at - 1)
        return F.struct(kind.alias("kind"), F.filter(F.transform(own, lambda x, j: F.struct((at + 2 + j).cast("int").alias("line"), x.alias("text"))), lambda r: F.trim(r["text"]) != "").alias("rows"))

    rows = rows.select("doc_id", "text", F.transform("begins", section).alias("sections"))
    of = lambda kind: F.flatten(F.transform(F.filter("sections", lambda s: s["kind"] == kind), lambda s: s["rows"]))
    rows = rows.select("doc_id", "text", of("body").alias("body"), of("summary").alias("summary"), of("references").alias("references"), F.exists("sections", lambda s: s["kind"] == "references").alias("has_references"))
    group = lambda x, i: F.regexp_extract(x["text"], BINDING, i)
    bound = F.transform(F.filter("body", lambda x: x["text"].rlike(BINDING)), lambda x: F.struct(x["line"].alias("line"), F.lower(group(x, 1)).alias("name"), group(x, 2).cast("double").alias("value"), group(x, 3).alias("unit")))
    held = lambda c: F.when(F.col("text").contains(c), F.lit(True)).otherwise(False)
    decimals = lambda lines: F.when(held("."), F.flatten(F.transform(lines, lambda x: F.transform(_all(x["text"], DECIMAL), lambda m: F.struct(x["line"].alias("line"), m.alias("raw"), m.cast("double").alias("value"))))))
    plain = F.filter("body", lambda x: ~x["text"].rlike(BINDING))
    return rows.select("*", F.when(held("="), bound).alias("bindings"), decimals(plain).alias("decimals"), decimals(F.col("summary")).alias("summary_decimals"))


def _found(checker: str, severity: str, items: Column, line: Callable[[Column], Column], detail: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.transform(items, lambda x: F.struct(F.lit(checker).alias("checker"), F.lit(severity).alias("severity"), line(x).cast("int").alias("line"), detail(x).cast("string").alias("detail"))), F.array().cast(_FINDING))


def _matches(checker: str, severity: str, rows: Column | str, found: Callable[[Column], Column]) -> Column:
    """A finding for each item of what `found` makes of a line's text."""
    items = F.flatten(F.transform(rows, lambda r: F.transform(found(r["text"]), lambda m: F.struct(r["line"].alias("line"), m.alias("m")))))
    return _found(checker, severity, items, lambda x: x["line"], lambda x: x["m"])


def _later(items: Column, key: str) -> Column:
    """The items whose key an earlier one has."""
    return F.filter(items, lambda x, i: F.exists(F.slice(items, 1, i), lambda y: y[key] == x[key]))


def _when(needs: str, findings: Column) -> Column:
    """Most texts don't hold what a checker looks for, and skip it."""
    return F.when(F.contains(F.lower("text"), F.lit(needs)), findings).otherwise(F.array().cast(_FINDING))


def _unbacked(decimals: str, known: Column) -> Column:
    return F.filter(decimals, lambda d: ~F.exists(known, lambda v: T.close(d["value"], v, TOLERANCE)))


def checkers() -> dict[str, Column]:
    """The nine checkers by name, each the findings of a row of `parts`."""
    prose = F.concat("body", "summary")
    files = lambda rows: F.flatten(F.transform(rows, lambda r: F.transform(_all(r["text"], FIGURE), lambda t: F.struct(r["line"].alias("line"), F.regexp_extract(t, 'file="([^"]*)"', 1).alias("file"), t.contains('caption="').alias("told")))))
    urls = F.filter(F.transform("references", lambda r: F.struct(r["line"].alias("line"), F.regexp_extract(r["text"], "https?://[^ )]+", 0).alias("url"))), lambda x: x["url"] != "")
    entries = F.size(F.filter("references", lambda r: ~r["text"].startswith(" ")))
    names = F.array_distinct(F.transform("bindings", lambda b: b["name"]))
    of = lambda n: F.filter("bindings", lambda b: b["name"] == n)
    mixed = F.filter(F.transform(names, lambda n: F.struct(n.alias("name"), of(n).alias("own"))), lambda x: F.size(F.array_distinct(F.transform(x["own"], lambda b: b["unit"]))) > 1)
    missing = lambda m: ~F.exists("references", lambda r: F.contains(r["text"], F.concat(F.lit("@"), m)))
    year = lambda t: F.filter(F.transform(_all(t, r"\(((?:19|20)[0-9]{2})\)", 1), lambda y: y.cast("int")), lambda y: y > NOW)
    declared = F.transform("bindings", lambda b: b["value"])
    return {
        "content": F.concat(
            _matches("content", "HARD", prose, lambda t: F.transform(_all(t, PLACEHOLDER), F.lower)),
            _when("[[", _matches("content", "WARN", prose, lambda t: F.when(t.contains("[[") & ~t.contains("]]"), F.array(F.lit("[["))).otherwise(F.array().cast("array<string>")))),
        ),
        "style": _matches("style", "WARN", F.filter("body", lambda r: functools.reduce(lambda a, b: a | b, [F.contains(F.lower(r["text"]), F.lit(p)) for p in PHRASES])), lambda t: F.filter(F.array(*map(F.lit, PHRASES)), lambda p: F.contains(F.lower(t), p))),
        "numbers": F.when(F.size("bindings") > 0, _found("numbers", "WARN", _unbacked("decimals", declared), lambda d: d["line"], lambda d: d["raw"])).otherwise(F.array().cast(_FINDING)),
        "refs": F.when(F.col("has_references"), _matches("refs", "HARD", "body", lambda t: F.filter(_all(t, CITATION, 1), lambda n: ~n.cast("int").between(1, entries)))).otherwise(F.array().cast(_FINDING)),
        "figures": _when("[[fig ", F.concat(_found("figures", "WARN", F.filter(files(F.col("body")), lambda x: ~x["told"]), lambda x: x["line"], lambda x: x["file"]), _found("figures", "HARD", _later(files(F.col("body")), "file"), lambda x: x["line"], lambda x: x["file"]))),
        "sources": F.concat(_matches("sources", "HARD", "references", year), _when("http", _found("sources", "WARN", _later(urls, "url"), lambda x: x["line"], lambda x: x["url"]))),
        "units": _found("units", "WARN", mixed, lambda x: F.array_min(F.transform(x["own"], lambda b: b["line"])), lambda x: x["name"]),
        "summary": F.when(F.size("body") > 0, _found("summary", "HARD", _unbacked("summary_decimals", F.concat(F.coalesce(F.transform("decimals", lambda d: d["value"]), F.array().cast("array<double>")), F.coalesce(declared, F.array().cast("array<double>")))), lambda d: d["line"], lambda d: d["raw"])).otherwise(F.array().cast(_FINDING)),
        "claims": F.when(F.col("has_references") & F.col("text").contains("[@"), _matches("claims", "HARD", "body", lambda t: F.filter(_all(t, MARKER, 1), missing))).otherwise(F.array().cast(_FINDING)),
    }


def checked(docs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """doc_id, findings of every row: all findings of the checkers (all nine, or those named) as one array of checker, severity, line and detail. A null text has none."""
    known = checkers()
    rows = parts(docs).select("doc_id", F.concat(*[known[n] for n in names or known]).alias("findings"))
    return rows.unionByName(docs.where("text is null").select("doc_id", F.array().cast(_FINDING).alias("findings")))


def findings(docs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """doc_id, checker, severity, line, detail: a row a finding."""
    # an outer explode: the filter that Spark infers of an inner one is pushed below the arrays and computes them anew
    return checked(docs, names).select("doc_id", F.explode_outer("findings").alias("f")).where("f is not null").select("doc_id", "f.*")


def verdicts(docs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """doc_id, hard, warn, checkers (with findings, in order), verdict, exit_code of every row: 3 and fail with a hard finding, else 0 and pass."""
    count = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s)).cast("long")
    told = F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["checker"]))), ",")
    rows = checked(docs, names).select("doc_id", count("HARD").alias("hard"), count("WARN").alias("warn"), told.alias("checkers"))
    return rows.select("*", F.when(F.col("hard") > 0, "fail").otherwise("pass").alias("verdict"), F.when(F.col("hard") > 0, 3).otherwise(0).alias("exit_code"))
