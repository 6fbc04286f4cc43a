"""Text expressions shared by the operators, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the rules: a word, and what ends a line. A word: letters and digits, with hyphens and apostrophes inside.
TOKEN = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"
#: Every separator that ends a line.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def fold(text: Column) -> Column:
    """Lower case with the sharp s written out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def squeeze(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def without_tags(text: Column) -> Column:
    """Build tags in double brackets as one space."""
    return F.regexp_replace(text, r"(?s)\[\[.*?\]\]", " ")


def lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def ngrams(items: Column, n: int) -> Column:
    """All runs of n neighbours, joined by a space; none for shorter arrays."""
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(1), F.size(items) - n + 1), lambda i: F.array_join(F.slice(items, i, n), " "))).otherwise(F.array().cast("array<string>"))


def hashed(items: Column) -> Column:
    """64-bit hashes of an array's strings."""
    return F.transform(items, lambda x: F.xxhash64(x))


def gram_hashes(hashes: Column, n: int) -> Column:
    """64-bit hashes of all runs of n neighbours of an array of hashes; none for shorter arrays. So a string is hashed once, however many runs it is in."""
    return F.when(F.size(hashes) >= n, F.transform(F.sequence(F.lit(1), F.size(hashes) - n + 1), lambda i: F.xxhash64(F.slice(hashes, i, n)))).otherwise(F.array().cast("array<bigint>"))


def number(raw: Column) -> Column:
    """A finite number without thousands commas, or null."""
    value = F.replace(raw, F.lit(","), F.lit("")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def close(a: Column, b: Column, tolerance: float) -> Column:
    """Relative closeness: the difference is at most tolerance times the larger magnitude."""
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def written_ulp(raw: Column) -> Column:
    """One unit in the last written place of a literal."""
    plain = F.replace(raw, F.lit(","), F.lit(""))
    decimals = F.length(F.regexp_extract(plain, r"\.(\d*)", 1))
    exponent = F.coalesce(F.regexp_extract(plain, r"[eE]([+-]?\d+)", 1).try_cast("int"), F.lit(0))
    return F.pow(F.lit(10.0), exponent - decimals)


def canonical_url(url: Column) -> Column:
    """http and https only: scheme and host in lower case, no fragment; null otherwise."""
    parts = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^#]*)", 1), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(F.lower(parts[0]).isin("http", "https") & (parts[1] != ""), F.concat(F.lower(parts[0]), F.lit("://"), F.lower(parts[1]), parts[2]))


def valid_isbn10(code: Column) -> Column:
    """Weights ten to one, the sum divisible by 11; X is ten."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.when(F.substring(code, i, 1) == "X", F.lit(10)).otherwise(F.substring(code, i, 1).try_cast("int")) * (11 - i))
    return code.rlike("^[0-9]{9}[0-9X]$") & (F.aggregate(digits, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 11 == 0)


def valid_isbn13(code: Column) -> Column:
    digits = F.transform(F.sequence(F.lit(1), F.lit(13)), lambda i: F.substring(code, i, 1).try_cast("int") * F.when(i % 2 == 1, 1).otherwise(3))
    return code.rlike("^[0-9]{13}$") & (F.aggregate(digits, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0)


def ordered_coverage(shorter: Column, longer: Column) -> Column:
    """The share of the shorter array's items found in the longer one in order."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        found = F.array_position(F.slice(longer, a["at"] + 1, F.greatest(F.size(longer), F.lit(1))), x).cast("int")
        return F.struct(F.when(found > 0, a["at"] + found).otherwise(a["at"]).alias("at"), F.when(found > 0, a["n"] + 1).otherwise(a["n"]).alias("n"))

    return F.aggregate(shorter, start, step, lambda a: F.when(F.size(shorter) > 0, a["n"] / F.size(shorter)).otherwise(F.lit(0.0)))


def in_order(shorter: Column, longer: Column) -> Column:
    """Whether the longer array holds all items of the shorter one in order, in one pass over the longer one."""
    return F.aggregate(longer, F.lit(0), lambda at, x: F.when(x.eqNullSafe(F.get(shorter, at)) & (at < F.size(shorter)), at + 1).otherwise(at)) == F.size(shorter)
