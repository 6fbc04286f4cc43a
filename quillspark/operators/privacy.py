"""Privacy findings on texts, and the roll-up of findings to a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.shared import materialize
from .spans import band_join, spans
from .text import contains_any, line_rows

#: What the rules look for.
USER_PATH = r"C:\\Users\\([^\\/\s\"']+)|(?<![\w.~-])/home/([^\\/\s\"']+)"
#: Names that examples have in the place of a user's.
PLACEHOLDERS = ["<user>", "username", "%userprofile%", "example", "me"]
RESERVED = ["example.com", "users.noreply.github.com"]
BLANK = r"[ \t\xa0\u3000]*"
RESIDENT = rf"((?<![0-9])[0-9]{{6}}{BLANK}-{BLANK}[1-4][0-9]{{6}}(?![0-9]))"
PHONE = rf"((?<![0-9])01[016789]{BLANK}-{BLANK}[0-9]{{3,4}}{BLANK}-{BLANK}[0-9]{{4}}(?![0-9]))"
#: What is held near each other: five digits, a name of two to four syllables, and the places between at most.
NUMBER, NAME, NEAR = r"(?<![0-9])[0-9]{5}(?![0-9])", r"(?<![가-힣])[가-힣]{2,4}(?![가-힣])", 12
SNIPPET = 60
#: What every resident or phone number holds.
HYPHENED = rf"[0-9]{BLANK}-{BLANK}[0-9]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def emails(docs: DataFrame) -> DataFrame:
    """doc_id, email, exempt: role and reserved addresses are exempt."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit(EMAIL), F.lit(0))).alias("email"))
    local, domain = F.lower(F.substring_index("email", "@", 1)), F.lower(F.substring_index("email", "@", -1))
    return found.select("doc_id", "email", _exempt(local, domain).alias("exempt")).distinct()


def _exempt(local: Column, domain: Column) -> Column:
    reserved = domain.endswith(".invalid")
    for name in RESERVED:
        reserved = reserved | (domain == name) | domain.endswith(f".{name}")
    return local.startswith("noreply") | reserved


def denied_terms(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, line, term for each line that holds a denied term, whatever its case."""
    return line_rows(docs).select("doc_id", "line", F.explode(contains_any(F.col("text"), terms)).alias("term"))


def near_numbers(docs: DataFrame, gap: int = NEAR) -> DataFrame:
    """doc_id, line, pairs: neighbouring number runs of five digits or more on a line with at most `gap` characters between."""
    # the second run is looked at, not taken, so it may be the first of the next pair
    pattern = rf"[0-9]{{5,}}+(?=[^0-9]{{1,{gap}}}[0-9]{{5,}})"
    return line_rows(docs).select("doc_id", "line", F.regexp_count("text", F.lit(pattern)).cast("long").alias("pairs")).where("pairs > 0")


def may_hold_paths(text: Column) -> Column:
    """Whether `user_paths` may find anything in a text; false for most, at the price of a search for two words."""
    return text.contains("C:\\Users\\") | text.contains("/home/")


def may_hold_identities(text: Column) -> Column:
    """Whether `identity_numbers` may find anything in a text."""
    return text.contains("-") & text.rlike(HYPHENED)


def user_paths(docs: DataFrame) -> DataFrame:
    """doc_id, line, name for each path of a user's folder on a line; placeholder names are left out."""
    names = F.zip_with(F.regexp_extract_all("text", F.lit(USER_PATH), F.lit(1)), F.regexp_extract_all("text", F.lit(USER_PATH), F.lit(2)), lambda x, y: F.concat(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))))
    lines = line_rows(docs.where(may_hold_paths(F.col("text")))).where(may_hold_paths(F.col("text")))
    return lines.select("doc_id", "line", F.explode(names).alias("name")).where(~F.lower("name").isin(PLACEHOLDERS))


def identity_numbers(docs: DataFrame) -> DataFrame:
    """doc_id, line, kind, number: resident numbers and mobile phone numbers on lines, by digest of their digits only; blanks may stand around the hyphens."""
    found = lambda kind, pattern: F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), F.sha2(F.regexp_replace(x, "[^0-9]", ""), 256).alias("number")))
    lines = line_rows(docs.where(may_hold_identities(F.col("text")))).where(F.col("text").contains("-"))
    return lines.select("doc_id", "line", F.explode(F.concat(found("resident", RESIDENT), found("phone", PHONE))).alias("f")).select("doc_id", "line", "f.kind", "f.number")


def named_numbers(docs: DataFrame, gap: int = NEAR) -> DataFrame:
    """doc_id, line, start, snippet: each five-digit number and name of two to four syllables on a line with at most `gap` characters between; start counts characters of the line from 0, the snippet has 60 characters at most.

    Numbers and names are found in one scan and written as rows, then joined by position; rows that repeat a doc_id are kept apart.
    """
    near = docs.where(F.col("text").rlike("[0-9]{5}") & F.col("text").rlike("[가-힣]{2}")).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.posexplode(T.lines(F.col("text"))).alias("at", "text"))
    lines = near.where(F.col("text").rlike("[0-9]{5}") & F.col("text").rlike("[가-힣]{2}")).select("row", "doc_id", (F.col("at") + 1).alias("line"), "text", F.col("text").alias("own"))
    found = materialize(spans(lines, {"number": NUMBER, "name": NAME}, "own"), "spans")
    sides = [found.where(F.col("kind") == kind).select("row", "line", "start", "end", *more) for kind, more in (("number", ["doc_id", "text"]), ("name", []))]
    pairs = band_join(*sides, ["row", "line"], gap)
    start, end = F.least("a_start", "b_start"), F.greatest("a_end", "b_end")
    return pairs.select(F.col("a_doc_id").alias("doc_id"), "line", start.alias("start"), F.substr("a_text", (start + 1).cast("int"), F.least(end - start, F.lit(SNIPPET)).cast("int")).alias("snippet"))


def counted_findings(docs: DataFrame, terms: list[str], identities: bool = False) -> DataFrame:
    """doc_id, hard, warn: the findings of each row counted within it, in one pass: distinct addresses, denied terms by line, users' paths; with `identities` resident and phone numbers too."""
    text = F.coalesce("text", F.lit(""))
    # most texts hold no address, and a call for its sign costs less than the pattern
    mails = F.when(text.contains("@"), F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    exempt = F.filter(mails, lambda m: _exempt(F.lower(F.substring_index(m, "@", 1)), F.lower(F.substring_index(m, "@", -1))))
    # most texts hold no term at all, and are not cut into lines
    low = F.lower(text)
    held = F.lit(False)
    for t in terms:
        held = held | low.contains(t)
    per_line = F.aggregate(T.lines(low), F.lit(0), lambda a, line: a + sum(line.contains(t).cast("int") for t in terms))
    names = lambda i: F.regexp_extract_all(text, F.lit(USER_PATH), F.lit(i))
    paths = F.filter(F.zip_with(names(1), names(2), lambda x, y: F.concat(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit("")))), lambda n: ~F.lower(n).isin(PLACEHOLDERS))
    hard = F.size(mails) - F.size(exempt) + F.when(held, per_line).otherwise(0) + F.when(text.contains("Users") | text.contains("/home/"), F.size(paths)).otherwise(0)
    if identities:
        hard = hard + F.when(text.contains("-"), F.regexp_count(text, F.lit(RESIDENT)) + F.regexp_count(text, F.lit(PHONE))).otherwise(0)
    return docs.select("doc_id", hard.cast("long").alias("hard"), F.size(exempt).cast("long").alias("warn"))


def gate(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, hard, warn, ok, exit_code: the verdict on all rules: addresses, users' paths, denied terms, resident and phone numbers are hard, exempt addresses and numbers near a name are warnings."""
    near = named_numbers(docs).select("doc_id", F.lit(0).cast("long").alias("hard"), F.lit(1).cast("long").alias("warn"))
    return verdicts(counted_findings(docs, terms, identities=True).unionByName(near))


def verdicts(counts: DataFrame) -> DataFrame:
    """doc_id, hard, warn, ok, exit_code from counts (doc_id, hard, warn): 3 with a hard finding, 2 with a warning alone, else 0."""
    sums = counts.groupBy("doc_id").agg(F.sum("hard").alias("hard"), F.sum("warn").alias("warn"))
    return sums.select("doc_id", "hard", "warn", (F.col("hard") == 0).alias("ok"), F.when(F.col("hard") > 0, 3).when(F.col("warn") > 0, 2).otherwise(0).alias("exit_code"))


def findings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, code, severity: one row a finding."""
    mail = emails(docs).select("doc_id", F.lit("email").alias("code"), F.when(F.col("exempt"), "WARN").otherwise("HARD").alias("severity"))
    denied = denied_terms(docs, terms).select("doc_id", F.lit("denied_term").alias("code"), F.lit("HARD").alias("severity"))
    paths = user_paths(docs).select("doc_id", F.lit("user_path").alias("code"), F.lit("HARD").alias("severity"))
    return mail.unionByName(denied).unionByName(paths)


def rollup(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, hard, warn, ok, exit_code of every document: 3 with a hard finding, 2 with a warning alone, else 0."""
    counts = found.groupBy("doc_id").agg(F.count_if(F.col("severity") == "HARD").alias("h"), F.count_if(F.col("severity") == "WARN").alias("w"))
    hard, warn = F.coalesce("h", F.lit(0)), F.coalesce("w", F.lit(0))
    return docs.select("doc_id").distinct().join(counts, "doc_id", "left").select("doc_id", hard.alias("hard"), warn.alias("warn"), (hard == 0).alias("ok"), F.when(hard > 0, 3).when(warn > 0, 2).otherwise(0).alias("exit_code"))
