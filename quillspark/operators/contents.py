"""Marked-up reports, declared rules and schemas, catalogues and manifests: what stands in a text or a JSON value, as rows."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import materialize, task_partitions
from . import claims, forms, privacy
from .text import keyed_lines

# The grammar of marked-up reports.
SECTION = r"^##\s*SECTION:\s*(.+?)\s*$"
TAG = r"^\[\[(/?[A-Za-z]+)(.*)\]\]$"
KNOWN = ["EQ", "FIG", "TABLE", "URL"]
ATTRIBUTE = r'([A-Za-z_][A-Za-z0-9_-]*)(?:=(?:"([^"]*)"|([^\s"]+)))?'
#: Names: in backticks, up to four capitalised words, Korean institutions. The second also takes what stands before it.
BACKTICK, CAPITAL, INSTITUTION = r"`([^`\n]+)`", r"([.!?]\s+|^|[^A-Za-z0-9`])([A-Z][a-z0-9]+(?: [A-Z][a-z0-9]+){0,3})", "[가-힣]{2,}(?:대학교|연구소|학회|재단|병원)"


def content_blocks(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id, line, section, kind, text of marked-up reports: para (its lines joined), eq, fig, url (the tag's attributes), table (the same) and row (a line inside of a table).

    Headings `## SECTION: x` open a section. Fault rows: unknown_tag, and tag_outside for a tag before any section; texts before any section aren't kept. line is the block's first.
    Texts are dealt over `partitions` (the session's number, where none is given) once, and read once.
    """
    by = Window.partitionBy("row").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tag, rest = F.regexp_extract("text", TAG, 1), F.trim(F.regexp_extract("text", TAG, 2))
    head = F.nullif(F.regexp_extract("text", SECTION, 1), F.lit(""))
    rows = keyed_lines(docs, partitions or task_partitions(docs)).select("row", "doc_id", "line", F.trim("text").alias("text"), head.alias("head")).withColumn("tag", F.nullif(tag, F.lit("")))
    opens = F.when(F.col("tag") == "TABLE", 1).when(F.col("tag") == "/TABLE", -1).otherwise(0)
    plain = F.col("head").isNull() & F.col("tag").isNull() & (F.col("text") != "")
    placed = rows.select("*", plain.alias("plain"), F.last("head", ignorenulls=True).over(by).alias("section"), F.sum(opens).over(by).alias("open"), F.sum((~plain).cast("int")).over(by).alias("part"))
    inside, is_tag = F.col("section").isNotNull(), F.col("head").isNull() & F.col("tag").isNotNull() & ~F.col("tag").startswith("/")
    known = F.regexp_replace("tag", "^/", "").isin(KNOWN)
    name = F.when(F.col("plain"), F.when(F.col("open") <= 0, "para").otherwise("row")).when(~known, "unknown_tag").when(~inside, "tag_outside").otherwise(F.lower("tag"))
    kept = placed.where((F.col("plain") & inside) | is_tag).select("row", "doc_id", "section", "part", "line", name.alias("kind"), F.when(F.col("plain"), F.col("text")).otherwise(rest).alias("text"))
    # the lines of a paragraph lie in one part; any other block is a line
    place = F.when(F.col("kind") == "para", F.col("part")).otherwise(F.col("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    return kept.groupBy("row", "doc_id", "section", "kind", place.alias("place")).agg(F.min("line").alias("line"), text.alias("text")).select("doc_id", "line", "section", "kind", "text")


def tag_attributes(blocks: DataFrame) -> DataFrame:
    """doc_id, line, key, value of the attributes of tags: key="v", key=v, or a flag alone (value null); of equal keys the last counts."""
    group = lambda i: F.regexp_extract_all("text", F.lit(ATTRIBUTE), F.lit(i))
    each = blocks.where(~F.col("kind").isin("para", "row")).select("doc_id", "line", F.posexplode(F.arrays_zip(group(0).alias("whole"), group(1).alias("key"), group(2).alias("quoted"), group(3).alias("plain"))).alias("at", "a"))
    value = F.when(F.col("a.whole").contains("="), F.concat("a.quoted", "a.plain"))
    return each.select("doc_id", "line", "at", F.col("a.key").alias("key"), value.alias("value")).groupBy("doc_id", "line", "key").agg(F.max_by(F.struct("value"), "at").alias("v")).select("doc_id", "line", "key", "v.value")


def entities(docs: DataFrame, stop: list[str]) -> DataFrame:
    """doc_id, kind, name, n, first (its place among the names of its kind, from 0) of the names of a text. A capitalised word that is a stop word, or alone at the start of a sentence, is none."""
    text = F.coalesce("text", F.lit(""))
    found = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    one = lambda kind, names: F.transform(names, lambda x, i: F.struct(F.lit(kind).alias("kind"), x.alias("name"), i.alias("at")))
    pairs = F.transform(F.arrays_zip(found(CAPITAL, 1).alias("before"), found(CAPITAL, 2).alias("name")), lambda p: F.when(p["name"].isin(stop) | ((F.instr(p["name"], " ") == 0) & ((p["before"] == "") | p["before"].rlike("^[.!?]"))), F.lit(None)).otherwise(p["name"]))
    every = F.concat(one("code", found(BACKTICK, 1)), one("capital", pairs), one("institution", found(INSTITUTION, 0)))
    each = docs.select("doc_id", F.explode(F.filter(every, lambda x: x["name"].isNotNull())).alias("x"))
    return each.groupBy("doc_id", "x.kind", "x.name").agg(F.count(F.lit(1)).alias("n"), F.min("x.at").cast("long").alias("first"))


def title_pattern(title_format: str) -> str:
    """The pattern of a format of titles: {x} stands for one character or more, all else for itself."""
    return "^" + ".+".join(re.escape(part) for part in re.split(r"\{[^{}]*\}", title_format)) + "$"


def phrase_caps(docs: DataFrame, rules: list[tuple[str, str, int]]) -> DataFrame:
    """doc_id, rule, n of the rules (name, pattern, most) that a text breaks: its pattern is found more than `most` times. One pass over each text."""
    return docs.select("doc_id", F.explode(_broken(rules)).alias("x")).select("doc_id", "x.rule", "x.n")


def _broken(rules: list[tuple[str, str, int]]) -> Column:
    """The rules that a text breaks: rule, n, most."""
    counts = F.array(*[F.struct(F.lit(name).alias("rule"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(pattern)).cast("long").alias("n"), F.lit(most).alias("most")) for name, pattern, most in rules])
    return F.filter(counts, lambda x: x["n"] > x["most"])


_KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING", "boolean": "^BOOLEAN", "integer": "^BIGINT", "number": "^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)", "null": "^VOID"}


def _errors(value: Column, schema: dict, where: Column) -> Column:
    """The paths and faults of a variant under a schema."""
    kind = F.schema_of_variant(value)
    own = [F.lit(None).cast("string")]
    parts: list[Column] = []
    if "enum" in schema:
        own.append(F.when(~F.coalesce(F.to_json(value).isin([json.dumps(x, ensure_ascii=False) for x in schema["enum"]]), F.lit(False)), F.concat(where, F.lit(": enum"))))
    if "properties" in schema or "required" in schema or schema.get("additionalProperties") is False:
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        keys = F.map_keys(fields)
        own += [F.when(~F.array_contains(keys, name), F.concat(where, F.lit(f".{name}: missing"))) for name in schema.get("required", [])]
        known = schema.get("properties", {})
        if schema.get("additionalProperties") is False:
            parts.append(F.transform(F.array_sort(F.filter(keys, lambda k: ~k.isin(list(known)))), lambda k: F.concat(where, F.lit("."), k, F.lit(": additional"))))
        for name, sub in known.items():
            inner = F.try_element_at(fields, F.lit(name))
            parts.append(F.when(F.array_contains(keys, name), _errors(inner, sub, F.concat(where, F.lit(f".{name}")))))
    if "items" in schema:
        items = F.try_variant_get(value, "$", "array<variant>")
        parts.append(F.flatten(F.transform(items, lambda x, i: _errors(x, schema["items"], F.concat(where, F.lit("["), i.cast("string"), F.lit("]"))))))
    none = F.array().cast("array<string>")
    found = F.concat(F.array_compact(F.array(*own)), *[F.coalesce(p, none) for p in parts])
    if "type" not in schema:
        return found
    return F.when(F.coalesce(kind.rlike(_KINDS[schema["type"]]), F.lit(False)), found).otherwise(F.array(F.concat(where, F.lit(f": type {schema['type']}"))))


def schema_errors(rows: DataFrame, key: str, text: str, schema: dict) -> DataFrame:
    """key, error of JSON texts that break a schema of type, enum, required, properties, additionalProperties and items; '$: no JSON' for a text that is none, or null.

    The schema is declared, so it becomes one expression on the parsed value; nothing leaves the JVM.
    """
    parsed = rows.select(key, F.try_parse_json(text).alias("_value"))
    errors = F.when(F.col("_value").isNull(), F.array(F.lit("$: no JSON"))).otherwise(_errors(F.col("_value"), schema, F.lit("$")))
    return parsed.select(key, F.explode(errors).alias("error"))


def fingerprints(blocks: DataFrame, key: str) -> DataFrame:
    """key, text_digest, shape_digest, cells, equations, pictures of documents' blocks: digests of all texts without white space, and of kinds and places without texts, in document order."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")
    place = F.concat_ws(":", "kind", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("tab", "depth", "row", "col", "row_span", "col_span")])
    ordered = F.array_sort(F.collect_list(F.struct("member", "seq", text.alias("text"), place.alias("place"))))
    count = lambda k: F.count_if(F.col("kind") == k)
    per = blocks.groupBy(key).agg(ordered.alias("b"), count("cell").alias("cells"), count("equation").alias("equations"), count("picture").alias("pictures"))
    digest = lambda part, sep: F.sha2(F.array_join(F.transform("b", lambda x: x[part]), sep), 256)
    return per.select(key, digest("text", "").alias("text_digest"), digest("place", "|").alias("shape_digest"), "cells", "equations", "pictures")


def attached_captions(blocks: DataFrame, caption: str) -> DataFrame:
    """doc, seq, kind, text, caption of blocks (doc, seq, kind, text): a paragraph that is written like a caption right after an object becomes its caption and no block of its own."""
    by = Window.partitionBy("doc").orderBy("seq")
    here = (F.col("kind") == "paragraph") & F.coalesce(F.col("text").rlike(caption), F.lit(False))
    rows = blocks.select("doc", "seq", "kind", "text", here.alias("here")).select("*", F.lag("kind").over(by).alias("before"), F.lead("here").over(by).alias("next"), F.lead("text").over(by).alias("next_text"))
    absorbed = F.col("here") & F.coalesce(F.col("before") != "paragraph", F.lit(False))
    return rows.where(~absorbed).select("doc", "seq", "kind", "text", F.when((F.col("kind") != "paragraph") & F.col("next"), F.col("next_text")).alias("caption"))


def cached_sources(cited: DataFrame, cache: DataFrame) -> DataFrame:
    """kind, key, state of cited sources against a cache (kind, slug, record: JSON): absent, unreadable, mismatch (the record doesn't echo its key), untitled, unverified (without url, hash and time) or verified.

    A slug is the key in lower case with all but letters, digits, points and hyphens as underscores. Of several records of a slug the smallest counts.
    """
    slug = F.regexp_replace(F.lower("key"), "[^a-z0-9.-]", "_")
    one = cache.groupBy("kind", "slug").agg(F.min("record").alias("record"), F.lit(True).alias("there"))
    rows = cited.where("key is not null").select("kind", "key").distinct().withColumn("slug", slug).join(one, ["kind", "slug"], "left")
    own = F.when(F.col("kind") == "doi", F.get_json_object("record", "$.doi")).otherwise(F.get_json_object("record", "$.isbn"))
    has = lambda path: F.trim(F.coalesce(F.get_json_object("record", path), F.lit(""))) != ""
    sound = has("$.url") & F.coalesce(F.get_json_object("record", "$.sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)) & has("$.fetched_at")
    state = F.when(F.col("there").isNull(), "absent").when(F.try_parse_json("record").isNull(), "unreadable").when(~F.coalesce(F.lower(own) == F.lower("key"), F.lit(False)), "mismatch").when(~has("$.title"), "untitled").when(sound, "verified").otherwise("unverified")
    return rows.select("kind", "key", state.alias("state"))


def module_faults(modules: DataFrame, needs: DataFrame, payloads: DataFrame) -> DataFrame:
    """module, code, detail of a catalogue (module, version) with its needs (module, needs, least) and payloads (module, name): duplicate modules, versions that aren't three numbers, needs that are missing or too old, names that two modules bring."""
    version = lambda c: F.transform(F.split(c, r"\."), lambda x: x.cast("int"))
    plain = F.col("version").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$")
    twice = modules.groupBy("module").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("module", F.lit("duplicate").alias("code"), F.col("n").cast("string").alias("detail"))
    odd = modules.where(~F.coalesce(plain, F.lit(False))).select("module", F.lit("version").alias("code"), F.coalesce("version", F.lit("")).alias("detail"))
    best = modules.where(plain).groupBy(F.col("module").alias("needs")).agg(F.max(version(F.col("version"))).alias("have"))
    listed = modules.select(F.col("module").alias("needs"), F.lit(True).alias("listed")).distinct()
    wanted = needs.join(listed, "needs", "left").join(best, "needs", "left")
    code = F.when(F.col("listed").isNull(), "missing").when(F.col("have").isNull() | (F.col("have") < version(F.col("least"))), "too_old")
    unmet = wanted.select("module", code.alias("code"), F.col("needs").alias("detail")).where("code is not null").distinct()
    shared = payloads.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    clash = payloads.distinct().join(shared, "name").select("module", F.lit("collision").alias("code"), F.col("name").alias("detail"))
    return twice.unionByName(odd).unionByName(unmet).unionByName(clash)


def manifest_entries(manifests: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, digest of JSON manifests in any of three forms: {path: digest}, {"files": [{"path", "sha256"}]}, [{"path", "sha256"}]; entries without a digest of text are left out."""
    value = manifests.select(key, F.try_parse_json(text).alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    pair = lambda x: F.struct(F.try_variant_get(x, "$.path", "string").alias("path"), F.try_variant_get(x, "$.sha256", "string").alias("digest"))
    listed = lambda path: F.transform(get(path, "array<variant>"), pair)
    flat = F.transform(F.map_entries(get("$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("path"), F.when(F.schema_of_variant(e["value"]) == "STRING", F.try_variant_get(e["value"], "$", "string")).alias("digest")))
    every = F.coalesce(listed("$.files"), listed("$"), flat)
    return value.select(key, F.explode(every).alias("e")).where("e.path is not null and e.digest is not null").select(key, "e.path", "e.digest")


def feedback_rows(docs: DataFrame) -> DataFrame:
    """id, doc_id, line, symptom, remedy of the rows of two cells or more in texts' tables, without heads and rules; the id is a digest of what was said, so said twice it is one."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), r"\|", -1), lambda x: F.trim(x))
    rows = keyed_lines(docs).where(F.col("text").startswith("|")).select("row", "doc_id", "line", cells.alias("c"))
    # the first row of a table is its head: no table row stands right before it
    by = Window.partitionBy("row").orderBy("line")
    body = rows.withColumn("before", F.lag("line").over(by)).where((F.col("before") == F.col("line") - 1) & (F.size("c") >= 2) & ~F.col("c")[0].rlike("^:?-{2,}:?$"))
    said = body.select("doc_id", "line", F.col("c")[0].alias("symptom"), F.col("c")[1].alias("remedy")).where("symptom <> '' and remedy <> ''")
    return said.groupBy(F.sha2(F.concat_ws("\x1f", "symptom", "remedy"), 256).alias("id"), "symptom", "remedy").agg(F.min(F.struct("doc_id", "line")).alias("at")).select("id", "at.doc_id", "at.line", "symptom", "remedy")


def fill_presence(values: DataFrame, cells: DataFrame) -> DataFrame:
    """doc, value, code of declared values (doc, value, wanted): missing where no cell of the document holds a wanted one, kept where one holds an unwanted one. Values without text are left out."""
    squeezed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")
    own = values.select("doc", "value", "wanted", squeezed("value").alias("v")).where("v <> ''").distinct()
    # each document's declared values go to its cells as one array, so no cell is copied
    lists = own.groupBy("doc").agg(F.collect_set("v").alias("vs"))
    held = cells.join(lists, "doc").select("doc", F.explode(F.filter("vs", lambda v: F.contains(squeezed("text"), v))).alias("v")).distinct().withColumn("held", F.lit(True))
    code = F.when(F.col("wanted") & F.col("held").isNull(), "missing").when(~F.col("wanted") & F.col("held"), "kept")
    return own.join(held, ["doc", "v"], "left").select("doc", "value", code.alias("code")).where("code is not null")


def audit(docs: DataFrame, found: dict[str, tuple[str, DataFrame]], counted: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, hard, warn, checkers, exit_code of the findings (doc_id) of several checkers, each {name: (severity, rows)}: 3 with any HARD one, else 0; all documents are listed once.

    `counted` has checkers whose findings are counted in the rows of `docs` already, {name: (severity, column)}; a checker may be in both. Documents and findings are grouped once; those without an id are one document.
    """
    counted = counted or {}
    severity = {name: s for name, (s, _) in (counted | found).items()}
    count = lambda rows, listed, n: rows.select("doc_id", F.lit(listed).alias("listed"), *[n.get(name, F.lit(0)).cast("long").alias(f"n{i}") for i, name in enumerate(severity)])
    every = count(docs, True, {name: F.coalesce(column, F.lit(0)) for name, (_, column) in counted.items()})
    for name, (_, rows) in found.items():
        every = every.unionByName(count(rows, False, {name: F.lit(1)}))
    sums = [f"n{i}" for i in range(len(severity))]
    per = every.groupBy("doc_id").agg(F.max("listed").alias("listed"), *[F.sum(n).alias(n) for n in sums]).where("listed")
    total = lambda kind: sum((F.col(n) for n, s in zip(sums, severity.values()) if s == kind), F.lit(0).cast("long"))
    told = F.array_join(F.array_sort(F.array(*[F.when(F.col(n) > 0, name) for n, name in zip(sums, severity)])), ",")
    rows = per.select("doc_id", total("HARD").alias("hard"), total("WARN").alias("warn"), told.alias("checkers"))
    return rows.select("*", F.when(F.col("hard") > 0, 3).otherwise(0).alias("exit_code"))


def content_audit(docs: DataFrame, forbidden: list[str], allowed: str, rules: list[tuple[str, str, int]]) -> DataFrame:
    """The `audit` of six checkers: `forms.residue` of the forbidden phrases, `user_paths`, `identity_numbers`, `unit_mismatches`, `unlisted_citations`, `phrase_caps`.

    Texts are read in one pass. It counts what is counted within a row, and hands on the texts that another checker may find something in; these
    are written once with the counts. Forbidden phrases are counted where no span of `allowed` is, all other texts with them go to `residue`.
    """
    text = F.col("text")
    rows = docs.select("doc_id", "text", F.lower("text").alias("low"))
    rows = rows.select("doc_id", "text", "low", F.coalesce(forms.phrase_places(F.col("low"), forbidden), F.lit(0)).alias("places"), F.size(_broken(rules)).alias("caps"))
    rows = rows.select("*", F.when(F.col("places") > 0, F.col("low").rlike(allowed)).otherwise(False).alias("spanned"))
    may = privacy.may_hold_paths(text) | privacy.may_hold_identities(text) | claims.may_tell(text) | claims.may_cite(text) | claims.may_list(text)
    rows = rows.select("doc_id", F.when(F.col("spanned"), 0).otherwise(F.col("places")).alias("forbidden"), "caps", "spanned", F.when(F.col("spanned") | may, text).alias("text"))
    rows = materialize(rows, "audited")
    held = rows.where("text is not null")
    found = {
        "forbidden": ("HARD", forms.residue(held.where("spanned"), forbidden, allowed)),
        "user_paths": ("HARD", privacy.user_paths(held)),
        "identity_numbers": ("HARD", privacy.identity_numbers(held)),
        "unit_mismatches": ("WARN", claims.unit_mismatches(claims.numeric_claims(held, told=True)).select(F.col("doc_id"))),
        "unlisted_citations": ("WARN", claims.unlisted_citations(held)),
    }
    return audit(rows, found, {"forbidden": ("HARD", "forbidden"), "phrase_caps": ("WARN", "caps")})
