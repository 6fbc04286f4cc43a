"""Rows out of documents: lines, tokens, sentences and paragraphs, and what is counted on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.shared import materialize

#: Tokens of items that go to the texts whole.
BROADCAST_TOKENS = 1 << 18


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1), text of every line; a null text has none."""
    return docs.where("text is not null").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("line"), "text")


def keyed_lines(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """row, doc_id, line (from 1), text of every line: row tells the rows of `docs` apart, whatever their ids. It is to be used in one branch of a plan, or written first.

    With `partitions` whole texts are dealt over these by row, so that their lines needn't be.
    """
    rows = docs.where("text is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if partitions:
        rows = rows.repartition(partitions, "row")
    return rows.select("row", "doc_id", F.posexplode(T.lines(F.col("text"))).alias("at", "text")).select("row", "doc_id", (F.col("at") + 1).alias("line"), "text")


def prose_tokens(docs: DataFrame, least: int = 6) -> DataFrame:
    """doc_id, tokens of all prose lines in order: headings, table rows, rules and lines with fewer than `least` tokens are left out."""
    prose = F.filter(T.lines(T.without_tags(F.coalesce("text", F.lit("")))), lambda x: ~x.rlike(r"^\s*(#|\||[-=*_]{3,}\s*$)"))
    per_line = F.filter(F.transform(prose, T.tokens), lambda x: F.size(x) >= least)
    return docs.select("doc_id", F.flatten(per_line).alias("tokens"))


def ending_distribution(docs: DataFrame) -> DataFrame:
    """ending, sentences: how the sentences of all documents end."""
    sentence = F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0)))
    last = F.substring(F.trim(F.col("s")), -1, 1)
    ending = F.when(last == ".", "period").when(last == "!", "exclamation").when(last == "?", "question").otherwise("other")
    return docs.select(sentence.alias("s")).where(F.trim("s") != "").groupBy(ending.alias("ending")).agg(F.count(F.lit(1)).alias("sentences"))


def repeated_tics(docs: DataFrame, sizes: tuple[int, ...] = (2, 3), least: int = 3, top: int = 8) -> DataFrame:
    """doc_id, rank, phrase, uses: the phrases a document repeats most; ties go to the longer and then to the alphabet.

    A document is counted within its row: its phrases are sorted and their runs measured, so nothing is shuffled.
    """
    words = docs.select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    rows = words.select("doc_id", F.sort_array(F.concat(*[T.ngrams(F.col("w"), n) for n in sizes])).alias("g"))
    last = F.filter(F.transform("g", lambda x, i: F.when(F.coalesce(x != F.get("g", i + 1), F.lit(True)), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "g", last.alias("last"))
    uses = F.transform("last", lambda i, k: F.struct((F.coalesce(F.get("last", k - 1), F.lit(-1)) - i).alias("fewer"), (-F.length(F.get("g", i))).alias("shorter"), F.get("g", i).alias("phrase")))
    rows = rows.select("doc_id", F.slice(F.sort_array(F.filter(uses, lambda x: x["fewer"] <= -least)), 1, top).alias("best"))
    # an outer explode: the filter that Spark infers of an inner one is pushed below the arrays and counts them anew for every item
    return rows.select("doc_id", F.posexplode_outer("best").alias("at", "x")).where("at is not null").select("doc_id", (F.col("at") + 1).alias("rank"), F.col("x.phrase").alias("phrase"), (-F.col("x.fewer")).cast("long").alias("uses"))


def paragraph_statistics(docs: DataFrame) -> DataFrame:
    """source, paragraphs and their length: count, least, most, mean to two places, median. Paragraphs are parted by empty lines; headings, tables and comments are none."""
    rows = docs.select("source", F.explode(F.split("text", r"\n[ \t]*\n")).alias("p")).where((F.trim("p") != "") & ~F.col("p").rlike(r"^\s*(?:#|\||<!--)")).select("source", F.length(F.trim("p")).alias("n"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("paragraphs"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 2).alias("mean"), F.median("n").alias("median"))


def sentence_counts(docs: DataFrame) -> DataFrame:
    """doc_id, by_mark, by_match, by_line, by_clause: the sentences of a text as four rules part them: after a mark and white space; by what lies between marks; by marks and line ends; by clauses."""
    some = lambda parts: F.size(F.filter(parts, lambda x: F.trim(x) != "")).cast("long")
    text = F.coalesce("text", F.lit(""))
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return docs.select("doc_id", some(F.split(text, r"(?<=[.!?…])[ \n\t]+", -1)).alias("by_mark"), some(found(r"[^.!?]+[.!?]*")).alias("by_match"), some(found(r"[^.!?\n]+[.!?]?")).alias("by_line"), some(F.split(text, r"[.,。\n]", -1)).alias("by_clause"))


def masked_tags(text: Column) -> Column:
    """Every character of a build tag as a space, line ends apart, so that places and lines stay."""
    between, tags = F.split(text, r"(?s)\[\[.*?\]\]", -1), F.regexp_extract_all(text, F.lit(r"(?s)(\[\[.*?\]\])"), F.lit(1))
    return F.array_join(F.zip_with(between, tags, lambda x, t: F.concat(x, F.coalesce(F.regexp_replace(t, r"[^\n]", " "), F.lit("")))), "")


def tag_masks(docs: DataFrame) -> DataFrame:
    """doc_id, same_length, same_lines, plain, masked: a text whose tags are masked, as digests beside the text with each tag as one space."""
    mask = masked_tags(F.col("text"))
    count = lambda c: F.length(F.regexp_replace(c, r"[^\n]", ""))
    return docs.where("text is not null").select("doc_id", (F.length(mask) == F.length("text")).alias("same_length"), (count(mask) == count(F.col("text"))).alias("same_lines"), F.sha2(T.without_tags(F.col("text")), 256).alias("plain"), F.sha2(mask, 256).alias("masked"))


def heading_echoes(docs: DataFrame, labels: list[str]) -> DataFrame:
    """doc_id, line, text: headings that repeat a guide label, or begin with one and a colon."""
    inner = T.collapse(F.lower(F.regexp_replace("text", "^#+ *", "")))
    echo = F.lit(False)
    for label in labels:
        echo = echo | (inner == label) | inner.startswith(f"{label}:")
    return line_rows(docs).where(F.col("text").startswith("#") & echo)


def bold_segments(docs: DataFrame) -> DataFrame:
    """doc_id, segments, bold, bold_chars: how many segments a text has when it is cut at its bold spans, and how much of it is bold."""
    spans, between = F.regexp_extract_all("text", F.lit(r"\*\*([^*\n]+)\*\*"), F.lit(1)), F.split("text", r"\*\*[^*\n]+\*\*", -1)
    plain = F.size(F.filter(between, lambda x: x != ""))
    return docs.where("text is not null").select("doc_id", (plain + F.size(spans)).cast("long").alias("segments"), F.size(spans).cast("long").alias("bold"), F.aggregate(spans, F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("bold_chars"))


def length_statistics(docs: DataFrame) -> DataFrame:
    """source, lines and their length: count, least, most, mean to two places, median."""
    rows = docs.where("text is not null").select("source", F.explode(T.lines(F.col("text"))).alias("line")).where(F.trim("line") != "").select("source", F.length("line").alias("n"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_lines"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 2).alias("mean"), F.median("n").alias("median"))


def density(docs: DataFrame, pattern: str, warn: float = 3.0, hard: float = 4.5) -> DataFrame:
    """doc_id, hits, per_10k bytes, severity of a pattern's matches."""
    hits, size = F.regexp_count("text", F.lit(pattern)), F.octet_length("text")
    rate = F.when(size > 0, hits * 10000.0 / size).otherwise(F.lit(0.0))
    severity = F.when(rate >= hard, "HARD").when(rate >= warn, "WARN").otherwise("OK")
    return docs.where("text is not null").select("doc_id", hits.cast("long").alias("hits"), F.round(rate, 4).alias("per_10k"), severity.alias("severity"))


def element_counts(pages: DataFrame) -> DataFrame:
    """page_id, element, n: the opening tags of each page."""
    names = F.explode(F.regexp_extract_all(F.lower("html"), F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1)))
    return pages.select("page_id", names.alias("element")).groupBy("page_id", "element").agg(F.count(F.lit(1)).alias("n"))


def slots(counts: DataFrame) -> DataFrame:
    """element, pages, values, kind: alignment of all pages by element: chrome where every page has the same count, else slot."""
    pages = counts.select("page_id").distinct()
    n = pages.agg(F.count(F.lit(1)).alias("total"))
    per = counts.groupBy("element").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("n").alias("n_values"))
    # one row, so it may go everywhere
    return per.join(F.broadcast(n), F.lit(True)).select("element", "pages", "n_values", F.when((F.col("pages") == F.col("total")) & (F.col("n_values") == 1), "chrome").otherwise("slot").alias("kind"))


def urls(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", T.canonical_url(F.col("url")).alias("url"))


def checksum_rows(keys: DataFrame, column: str) -> DataFrame:
    """Codes made of a number, and whether they have valid check digits."""
    ten = F.lpad(F.col(column).cast("string"), 10, "0")
    thirteen = F.concat(F.lit("978"), ten)
    return keys.select(F.col(column).alias("code"), T.valid_isbn10(ten).alias("isbn10"), T.valid_isbn13(thirteen).alias("isbn13"))


def title_coverage(items: DataFrame, docs: DataFrame, least: int = 3) -> DataFrame:
    """item_id, doc_id whose documents hold all tokens of the item in order; items of fewer than `least` tokens are left out.

    A document must hold the item's rarest token, so the join is on that: one key for each item, and of a document only tokens that are one.
    Tokens go without the text that they are of: a row's key finds it again, and it is shuffled once, with the items that it may hold.
    """
    a = items.select("item_id", T.tokens(F.col("text")).alias("short")).where(F.size("short") >= least)
    # texts of one id and hash share their items, and each of them is looked through
    b = docs.where("text is not null").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("own"))
    each = b.select("own", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    wanted = a.select("item_id", F.explode(F.array_distinct("short")).alias("token"))
    # few tokens of items go to the texts, whose other tokens are then never shuffled
    asked = materialize(wanted.select("token").distinct(), "item-tokens")
    each = each.join(F.broadcast(asked) if asked.count() <= BROADCAST_TOKENS else asked, "token", "left_semi")
    uses = each.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    rare = wanted.join(uses, "token", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "token")).alias("rare")).select("item_id", F.col("rare.token").alias("token"))
    met = each.join(rare.join(a, "item_id"), "token").groupBy("own").agg(F.collect_set(F.struct("item_id", "short")).alias("items"))
    found = F.filter("items", lambda x: T.in_order(x["short"], F.col("long")))
    held = b.join(met, "own").select("doc_id", "items", T.tokens(F.col("text")).alias("long"))
    return held.select("doc_id", F.explode(F.transform(found, lambda x: x["item_id"])).alias("item_id")).select("item_id", "doc_id")


def contains_any(text: Column, terms: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t))
