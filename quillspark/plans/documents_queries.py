"""Queries on files, packages, form inventories, gates and measured pages, with the SQL that they equal.

The seats of forms are turns of conversations, the lines of pages those of orders; what they hold is written by the same expressions for Spark and SQL.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inventories, layout
from ..sources import files
from ..sources.tables import read_table
from .fixtures import literal
from .shared import dealt

#: Bytes that are texts in one encoding, another, or none, beside the documents.
BYTES = [(-1, "b0a1b3aa203132", "가나 12", "cp949"), (-2, "ff00ff", None, None), (-3, "ea b0 80", "가", "utf-8"), (-4, "", "", "utf-8"), (-5, None, None, None)]


def decoded_texts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    more = spark.createDataFrame([(i, None if h is None else bytearray(bytes.fromhex(h))) for i, h, _, _ in BYTES], "doc_id long, content binary")
    return files.decoded(docs.unionByName(more)).select("doc_id", F.length("text").cast("long").alias("chars"), "codec")


def json_events(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.when(x["event_id"] % 6 == 0, "").when(x["event_id"] % 6 == 1, '{"id": ').otherwise(F.to_json(F.struct(x["event_id"].alias("id"), x["event_type"].alias("kind"))))), "\n").alias("log"))
    return files.json_lines(rows, "user_id", "log", "id LONG, kind STRING", 2).select("user_id", F.col("line").cast("long").alias("line"), "value.id", "value.kind")


_PARAGRAPH = "<hp:p><hp:run><hp:t>{}</hp:t></hp:run>{}</hp:p>"
_CELL = '<hp:tc><hp:cellAddr colAddr="{}" rowAddr="0"/><hp:cellSpan colSpan="1" rowSpan="{}"/><hp:subList>{}</hp:subList></hp:tc>'
_SECTION = '<?xml version="1.0" encoding="UTF-8"?><hs:sec xmlns:hs="urn:s" xmlns:hp="urn:p" xmlns:hc="urn:c">{}</hs:sec>'
_DESCRIPTION = '<opf:package xmlns:opf="urn:o"><opf:manifest>{}</opf:manifest><opf:spine>{}</opf:spine></opf:package>'


def _package(number: int, title: str, url: str) -> bytes:
    """A package of two sections; some are no archive, or have a section that doesn't parse, lacks or is listed twice, or stands in another order."""
    if number % 11 == 5:
        return b"no archive"
    inner = f"<hp:tbl><hp:tr>{_CELL.format(0, 1, _PARAGRAPH.format('inner', ''))}</hp:tr></hp:tbl>"
    table = f"<hp:run><hp:tbl><hp:tr>{_CELL.format(0, 2, _PARAGRAPH.format('url', ''))}{_CELL.format(1, 1, _PARAGRAPH.format(escape(url), '<hp:run>' + inner + '</hp:run>'))}</hp:tr></hp:tbl></hp:run>"
    extra = "<hp:equation><hp:script>a over b</hp:script></hp:equation><hp:pic><hc:img binaryItemIDRef=\"image1\"/></hp:pic>"
    first = _SECTION.format(_PARAGRAPH.format(escape(title), table) + _PARAGRAPH.format("end", extra))
    second = _SECTION.format(_PARAGRAPH.format("more", ""))
    item = lambda i, name: f"<opf:item id={quoteattr(i)} href={quoteattr(name)}/>"
    items = item("s0", "Contents/section0.xml") + item("s1", "Contents/section1.xml") + (item("s2", "Contents/section2.xml") if number % 13 == 4 else "") + (item("s1", "Contents/section1.xml") if number % 17 == 2 else "")
    order = ["s1", "s0"] if number % 5 == 1 else ["s0", "s1"]
    spine = "".join(f'<opf:itemref idref="{i}"/>' for i in order + (["s2"] if number % 13 == 4 else []))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(files.DESCRIPTION, _DESCRIPTION.format(items, spine))
        z.writestr("Contents/section0.xml", first)
        z.writestr("Contents/section1.xml", second[:-5] if number % 7 == 3 else second)
    return out.getvalue()


def _packages(spark, sf_dir) -> DataFrame:
    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                yield pd.DataFrame({"page_id": part.page_id, "content": [_package(*row) for row in zip(part.page_id, part.title, part.url)]})

    pages = read_table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)</title>", 1).alias("title"), F.coalesce("url", F.lit("")).alias("url"))
    return pages.mapInPandas(build, "page_id long, content binary")


def _found(spark, sf_dir) -> DataFrame:
    return files.members(_packages(spark, sf_dir), "page_id")


def package_members(spark, sf_dir):
    return _found(spark, sf_dir).select("page_id", "member", "fault")


def package_sections(spark, sf_dir):
    return files.sections(_found(spark, sf_dir), "page_id")


def package_blocks(spark, sf_dir):
    return files.blocks(_found(spark, sf_dir), "page_id")


_NOW = "CASE (conv_id + turn) % 8 WHEN 0 THEN '( □ yes  □ no ) consent required' WHEN 1 THEN concat('owner : ', role, ' (서명)  ____ worker:') WHEN 2 THEN 'Labour Act 제3조, 제 12 조 of 2024-01-02' WHEN 3 THEN concat('official seal ', role) WHEN 4 THEN '[Form 7] Dear ☑ all □' WHEN 5 THEN '(yes, no) consent   notes: see' WHEN 6 THEN text ELSE '' END"
_WAS = f"CASE WHEN (conv_id * 7 + turn) % 5 = 0 THEN concat({_NOW}, ' (서명) 제9조 (□/□)') WHEN (conv_id + turn * 3) % 5 = 1 THEN replace({_NOW}, '☑', '□') WHEN turn % 9 = 4 THEN 'fixed words of the form:' ELSE {_NOW} END"
#: Conversations without a blank form.
_KNOWN = "conv_id % 6 <> 5"
_TAB = "CASE WHEN turn % 2 = 0 THEN conv_id % 3 END"
LAWS, SEALS, LABELS, OPTIONS, REQUIRED, DEAR, NOTES, PARTIES = ["Labour Act", "근로기준법"], ["official seal", "seal"], ["consent", "동의"], ["yes", "no", "예", "아니오"], ["required", "필수"], ["Dear", "귀하"], "notes:", ["owner", "worker", "work"]


def _turns(spark, sf_dir, text: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").selectExpr("conv_id AS doc", f"CAST({_TAB} AS long) AS tab", "CAST(turn AS long) AS seat", f"{text} AS text", "conv_id")


def _seats(spark, sf_dir) -> DataFrame:
    return _turns(spark, sf_dir, _NOW).drop("conv_id")


def _blank(spark, sf_dir) -> DataFrame:
    return _turns(spark, sf_dir, _WAS).where(_KNOWN).drop("conv_id")


def _of_seats(operator, *more):
    return lambda spark, sf_dir: operator(_seats(spark, sf_dir), *more)


def _gate(rules: inventories.Rules, by_address: bool = False, mark: bool = False, official: bool = False):
    def query(spark, sf_dir):
        seats, blank = _seats(spark, sf_dir), _blank(spark, sf_dir)
        now, was = (inventories.measures(x, DEAR, NOTES) for x in (seats, blank))
        written = inventories.written_seats(seats, blank, by_address)
        state = inventories.official_states(now, written) if official else inventories.states(now, written, mark)
        return inventories.gate(now, was, state, rules)

    return query


def _state(spark, sf_dir) -> DataFrame:
    seats, blank = _seats(spark, sf_dir), _blank(spark, sf_dir)
    return inventories.states(inventories.measures(seats, DEAR, NOTES), inventories.written_seats(seats, blank, False))


def consent_findings(spark, sf_dir):
    group = lambda x: inventories.consent_groups(x, LABELS, OPTIONS, REQUIRED)
    return inventories.consent_findings(group(_seats(spark, sf_dir)), group(_blank(spark, sf_dir)), _state(spark, sf_dir))


def seal_findings(spark, sf_dir):
    return inventories.seal_findings(inventories.seal_cells(_seats(spark, sf_dir), SEALS), inventories.seal_cells(_blank(spark, sf_dir), SEALS))


def party_findings(spark, sf_dir):
    return inventories.party_findings(inventories.party_values(_seats(spark, sf_dir), PARTIES), "owner", "worker", _state(spark, sf_dir))


#: Columns of a measured line, image, style and page.
_LINE = "CAST(l_suppkey AS bigint) AS doc, l_orderkey AS page, CAST(20 * l_linenumber + CASE WHEN l_partkey % 5 = 0 THEN 9 ELSE 0 END AS double) AS y0, CAST(20 * l_linenumber + CASE WHEN l_partkey % 5 = 0 THEN 19 ELSE 10 END AS double) AS y1, CAST(10 + CASE WHEN l_partkey % 13 = 0 THEN 3 ELSE 0 END AS double) AS size, CASE WHEN l_partkey % 7 = 1 THEN 'Figure 2' WHEN l_partkey % 7 = 2 THEN '- 4 -' ELSE l_returnflag END AS text"
_LINES = _LINE.replace("CAST(l_suppkey AS bigint)", "CAST(0 AS bigint)")
_OBJECT = "CAST(0 AS bigint) AS doc, o_orderkey AS page, CASE WHEN o_custkey % 3 = 0 THEN 'image' ELSE 'table' END AS kind, o_custkey % 4 AS figure, CAST(20 AS double) AS x0, CAST(60 + o_custkey % 50 * 10 AS double) AS x1, CAST(15 + o_custkey % 7 * 20 AS double) AS y0, CAST(35 + o_custkey % 7 * 20 AS double) AS y1"
_OBJECTS = "o_custkey % 2 = 0"
_MEASURE = "l_suppkey AS doc, l_orderkey AS page, max(l_discount * 300) AS white, max(CASE WHEN l_partkey % 97 = 0 THEN 4.0 ELSE 1.0 END) AS gap, sum(CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END) AS figures"
_STYLE = "l_orderkey AS doc, CAST(l_quantity AS int) * 100 AS height, CASE WHEN l_partkey % 11 = 0 THEN 'D02010' WHEN l_partkey % 11 = 1 THEN 'red' ELSE '000000' END AS colour, l_partkey % 10 = 0 AS bold, l_linenumber * 40 AS spacing"
_MARGIN = "o_orderkey AS doc, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE 1700 + o_custkey % 5 END AS left_margin, 2000 + o_custkey % 4 AS top_margin, 1 + o_custkey % 8 AS pages"
_MARGINS = "o_custkey % 19 <> 3"
_CELL_TEXT = "CASE WHEN (l_orderkey + l_linenumber * l_linenumber) % 4 = 0 OR l_orderkey % 9 = 2 THEN ' ' ELSE l_returnflag END"


def _lines(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").selectExpr(*_columns(_LINES))


def _columns(text: str) -> list[str]:
    """The parts of a list of columns."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


def _objects(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "orders").where(_OBJECTS).selectExpr(*_columns(_OBJECT))


def spacing_outliers(spark, sf_dir):
    return layout.spacing_outliers(_lines(spark, sf_dir), _objects(spark, sf_dir), 160.0)


def figure_faults(spark, sf_dir):
    lines, figures = _lines(spark, sf_dir), _objects(spark, sf_dir).where("kind = 'image'").drop("kind")
    blocks = lines.where("text <> 'R'").select("doc", "page", F.lit(300.0).alias("x0"), F.lit(400.0).alias("x1"), "y0", "y1")
    return layout.figure_faults(figures, blocks, lines, 500.0)


def header_blanks(spark, sf_dir):
    # a table per order: its lines are read by columns, two to a row
    rows = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.expr(f"max({_CELL_TEXT})").alias("text"))
    return layout.header_blanks(rows.selectExpr("l_orderkey AS doc", "CAST(0 AS bigint) AS tab", "CAST((l_linenumber - 1) DIV 3 AS bigint) AS row", "CAST((l_linenumber - 1) % 3 AS bigint) AS col", "text"))


def layout_verdicts(spark, sf_dir):
    head, *rest = _columns(_MEASURE)
    lines = dealt(read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_discount", "l_partkey"), "l_suppkey")
    rows = lines.groupBy("l_suppkey", "l_orderkey").agg(*[F.expr(x) for x in rest[1:]])
    return layout.layout_verdicts(rows.withColumnsRenamed({"l_suppkey": "doc", "l_orderkey": "page"}), 5, 60, 2)


def format_faults(spark, sf_dir):
    styles = read_table(spark, sf_dir, "lineitem").selectExpr(*_columns(_STYLE))
    margins = read_table(spark, sf_dir, "orders").where(_MARGINS).selectExpr(*_columns(_MARGIN))
    return layout.format_faults(styles, margins, 1000, 160, {"left_margin": 1701, "top_margin": 2000}, (1, 6))


def conversion_faults(spark, sf_dir):
    tags = F.regexp_extract_all(F.lower(F.coalesce("html", F.lit(""))), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    pairs = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), tags.alias("before"))
    return layout.conversion_faults(pairs.withColumn("after", F.expr("CASE WHEN key % 3 = 0 THEN reverse(before) WHEN key % 5 = 1 THEN slice(before, 1, greatest(size(before) - 1, 0)) ELSE before END")))


_POINTER = "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' None ' WHEN 2 THEN 'o0' ELSE concat('o', CAST(c_custkey % 10 AS {string})) END"


def pointer_faults(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    stages = orders.selectExpr("o_custkey AS ws", "o_orderkey % 9 AS stage", "CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS status")
    names = orders.selectExpr("o_custkey AS ws", "concat('o', CAST(o_orderkey % 10 AS string)) AS name")
    pointers = read_table(spark, sf_dir, "customer").selectExpr("c_custkey AS ws", f"{_POINTER.format(string='string')} AS pointer")
    return layout.pointer_faults(stages, pointers, names)


QUERIES = {
    "decoded_texts": decoded_texts,
    "json_events": json_events,
    "package_members": package_members,
    "package_sections": package_sections,
    "package_blocks": package_blocks,
    "checkbox_cells": _of_seats(inventories.checkbox_cells),
    "signature_cells": _of_seats(inventories.signature_cells),
    "seal_cells": _of_seats(inventories.seal_cells, SEALS),
    "statute_counts": _of_seats(inventories.statute_counts, LAWS),
    "stencil_fragments": _of_seats(inventories.stencil_fragments),
    "party_values": _of_seats(inventories.party_values, PARTIES),
    "consent_groups": _of_seats(inventories.consent_groups, LABELS, OPTIONS, REQUIRED),
    "consent_findings": consent_findings,
    "seal_findings": seal_findings,
    "party_findings": party_findings,
    "grant_gate": _gate(inventories.GRANT),
    "staff_gate": _gate(inventories.STAFF, mark=True),
    "petition_gate": _gate(inventories.PETITION, by_address=True, mark=True),
    "official_gate": _gate(inventories.OFFICIAL, official=True),
    "spacing_outliers": spacing_outliers,
    "figure_faults": figure_faults,
    "header_blanks": header_blanks,
    "layout_verdicts": layout_verdicts,
    "format_faults": format_faults,
    "conversion_faults": conversion_faults,
    "pointer_faults": pointer_faults,
}

_SQL_BYTES = ", ".join(f"({i}, {'NULL' if t is None else len(t)}, {literal(c)})" for i, _, t, c in BYTES)
_SQUEEZED = "regexp_replace(coalesce(text, ''), '\\s', '', 'g')"
_K = f"k AS (SELECT conv_id AS doc, {_TAB} AS tab, turn AS seat, coalesce(text, '') AS text, {_SQUEEZED} AS s FROM (SELECT conv_id, turn, {_NOW} AS text FROM conversations))"
_B = f"b AS (SELECT conv_id AS doc, {_TAB} AS tab, turn AS seat, coalesce(text, '') AS text, {_SQUEEZED} AS s FROM (SELECT conv_id, turn, {_WAS} AS text FROM conversations) WHERE {_KNOWN})"
_P = "pages_ AS (SELECT page_id, regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1) AS title, coalesce(url, '') AS url FROM pages WHERE page_id % 11 <> 5)"
_FILLER = "[_.:,·]|\\((?:서명|인|sign)\\)"


def _n(pattern: str, of: str = "text") -> str:
    return f"CAST(len(regexp_extract_all({of}, '{pattern}')) AS BIGINT)"


def _measured(name: str, of: str) -> str:
    sets = lambda p: f"list_sort(list_distinct(flatten(list(regexp_extract_all(s, '{p}')))))"
    return f"""{name} AS (SELECT doc, sum({_n(inventories.SIGNATURE, 's')}) AS signatures, sum({_n('[■☑●□☐]')}) AS slots, sum({_n('[■☑●]')}) AS marks, sum({_n('_{3,}|[.]{5,}')}) AS placeholders,
        count(*) FILTER (contains(s, 'Dear') OR contains(s, '귀하')) AS addressees, count(*) FILTER (contains(text, 'notes:')) AS notes, bool_or(regexp_matches(s, '{inventories.DATE}')) AS dated, {sets(inventories.HEADER)} AS headers, {sets(inventories.ARTICLE)} AS articles FROM {of} GROUP BY 1)"""


_SET_WRITTEN = "SELECT doc, count(*) AS written FROM b WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc = b.doc AND k.s = b.s) GROUP BY 1"
_AT_WRITTEN = "SELECT b.doc, count(*) AS written FROM b LEFT JOIN k ON k.doc = b.doc AND k.seat = b.seat AND k.tab IS NOT DISTINCT FROM b.tab WHERE k.s IS NULL OR k.s <> b.s GROUP BY 1"
_PLAIN_STATE = "CASE WHEN dated THEN 'final' WHEN coalesce(written, 0) > 0 THEN 'draft' ELSE 'blank' END"


def _gate_sql(rules: inventories.Rules, written: str = _SET_WRITTEN, state: str = _PLAIN_STATE) -> str:
    checks = ["SELECT doc, state, 'baseline_missing' AS code, 'SKIPPED' AS severity, CAST(1 AS BIGINT) AS n FROM r WHERE was.doc IS NULL"]
    for code, kind, name in rules:
        n = {"fewer": f"was.{name} - now.{name}", "lost": f"len(list_filter(was.{name}, lambda x: NOT list_contains(now.{name}, x)))", "new": f"len(list_filter(now.{name}, lambda x: NOT list_contains(was.{name}, x)))", "left": f"now.{name}"}[kind]
        severity = "CASE WHEN state = 'final' THEN 'HARD' ELSE 'WARN' END" if kind == "left" else "'HARD'"
        checks.append(f"SELECT doc, state, '{code}', {severity}, CAST({n} AS BIGINT) FROM r WHERE {n} > 0 AND " + ("state <> 'blank'" if kind == "left" else "was.doc IS NOT NULL"))
    return f"WITH {_K}, {_B}, {_measured('now', 'k')}, {_measured('was', 'b')}, w AS ({written}), r AS (SELECT now.doc, {state} AS state, now, was FROM now LEFT JOIN was ON was.doc = now.doc LEFT JOIN w ON w.doc = now.doc) " + " UNION ALL ".join(checks)


_MARKED_STATE = "CASE WHEN now.dated THEN 'final' WHEN coalesce(written, 0) > 0 OR now.marks > 0 THEN 'draft' ELSE 'blank' END"
_STATE = _PLAIN_STATE.replace("dated", "now.dated")
_Z = f"{_measured('now', 'k')}, w AS ({_SET_WRITTEN}), z AS (SELECT now.doc, {_STATE} AS state FROM now LEFT JOIN w ON w.doc = now.doc)"


def _groups(name: str, of: str) -> str:
    """The groups of consent of seats."""
    has = lambda words: "(" + " OR ".join(f"contains(s, '{w}')" for w in words) + ")"
    within = lambda x: f"CASE WHEN tab IS NULL THEN {x} ELSE bool_or({x}) OVER (PARTITION BY doc, tab) END"
    options = ", ".join(map(literal, OPTIONS))
    return f"""{name}0 AS (SELECT *, {within(has(LABELS))} AS labelled, {within(has(REQUIRED))} AS required FROM {of}), {name}1 AS (SELECT doc, tab, seat, required, regexp_extract_all(s, '\\(([^()]*)\\)', 1) AS g FROM {name}0 WHERE labelled),
        {name}2 AS (SELECT doc, tab, seat, required, unnest(g) AS inner_, unnest(range(len(g))) AS position FROM {name}1), {name}3 AS (SELECT *, {_n('[■☑●]', 'inner_')} AS marked, {_n('[■☑●□☐]', 'inner_')} AS slots, CAST(len(list_filter(regexp_split_to_array(inner_, '[,/]'), lambda x: regexp_replace(x, '[■☑●□☐]', '', 'g') IN ({options}))) AS BIGINT) AS named FROM {name}2),
        {name} AS (SELECT doc, tab, seat, position, CASE WHEN slots >= 2 THEN slots ELSE named END AS options, CASE WHEN slots >= 2 THEN 'glyphs' ELSE 'tokens' END AS basis, marked, required FROM {name}3 WHERE greatest(CASE WHEN slots >= 2 THEN slots ELSE named END, 0) >= 2)"""


def _seals(name: str, of: str) -> str:
    return f"""{name} AS (SELECT doc, tab, seat, concat_ws(',', CASE WHEN contains(s, 'officialseal') THEN 'officialseal' END, 'seal') AS labels, regexp_replace(replace(replace(s, 'officialseal', ''), 'seal', ''), '{_FILLER}', '', 'g') AS residue FROM {of} WHERE tab IS NOT NULL AND contains(s, 'seal'))"""


_PARTY = f"v0 AS (SELECT *, regexp_extract_all(s, 'worker|owner|work') AS l, regexp_split_to_array(s, 'worker|owner|work') AS p FROM k), v AS (SELECT doc, tab, seat, unnest(range(len(l))) AS position, unnest(l) AS label, unnest(list_transform(p[2:], lambda x: regexp_replace(x, '{_FILLER}', '', 'g'))) AS value FROM v0 WHERE len(l) > 0)"
_L = f"n AS (SELECT {_LINES} FROM lineitem)"
_O = f"o AS (SELECT {_OBJECT} FROM orders WHERE {_OBJECTS})"

ORACLE_SQL = {
    "decoded_texts": f"SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CASE WHEN text IS NOT NULL THEN 'utf-8' END AS codec FROM documents UNION ALL SELECT * FROM (VALUES {_SQL_BYTES})",
    "json_events": "WITH k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id, event_type) - 1 AS line, event_id AS id, event_type AS kind FROM events) SELECT * FROM k WHERE line >= 2 AND id % 6 > 1",
    "package_members": f"WITH {_P} SELECT page_id, m AS member, CASE WHEN page_id % 7 = 3 AND m = 'Contents/section1.xml' THEN 'malformed' END AS fault FROM pages_, (VALUES ('Contents/content.hpf'), ('Contents/section0.xml'), ('Contents/section1.xml')) AS t(m) UNION ALL SELECT page_id, NULL, 'no archive' FROM pages WHERE page_id % 11 = 5",
    "package_sections": f"""WITH {_P}, s AS (SELECT page_id, CAST(p AS BIGINT) AS position, CASE WHEN p = 2 THEN 2 WHEN page_id % 5 = 1 THEN 1 - p ELSE p END AS i FROM pages_, range(3) AS t(p) WHERE p < 2 OR page_id % 13 = 4)
        SELECT page_id, position, 'Contents/section' || i || '.xml' AS member, CASE WHEN i = 1 AND page_id % 17 = 2 THEN 'duplicate' WHEN i = 2 THEN 'missing' END AS fault FROM s""",
    "package_blocks": f"""WITH {_P} SELECT page_id, 'Contents/section0.xml' AS member, CAST(t.seq AS BIGINT) AS seq, t.kind, CASE t.seq WHEN 0 THEN title WHEN 2 THEN url ELSE t.text END AS text, CAST(tab AS BIGINT) AS tab, CAST(depth AS BIGINT) AS depth, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, CAST(row_span AS BIGINT) AS row_span, CAST(col_span AS BIGINT) AS col_span
        FROM pages_, (VALUES (0, 'paragraph', '', NULL, NULL, NULL, NULL, NULL, NULL), (1, 'cell', 'url', 0, 1, 0, 0, 2, 1), (2, 'cell', '', 0, 1, 0, 1, 1, 1), (3, 'cell', 'inner', 1, 2, 0, 0, 1, 1), (4, 'paragraph', 'end', NULL, NULL, NULL, NULL, NULL, NULL), (5, 'equation', 'a over b', NULL, NULL, NULL, NULL, NULL, NULL), (6, 'picture', 'image1', NULL, NULL, NULL, NULL, NULL, NULL)) AS t(seq, kind, text, tab, depth, row, col, row_span, col_span)
        UNION ALL SELECT page_id, 'Contents/section1.xml', 0, 'paragraph', 'more', NULL, NULL, NULL, NULL, NULL, NULL FROM pages_ WHERE page_id % 7 <> 3""",
    "checkbox_cells": f"WITH {_K} SELECT doc, tab, seat, {_n('[■☑●]')} AS marked, {_n('[□☐]')} AS unmarked FROM k WHERE {_n('[■☑●□☐]')} > 0",
    "signature_cells": f"WITH {_K} SELECT doc, tab, seat, array_to_string(list_sort(list_distinct(regexp_extract_all(s, '{inventories.SIGNATURE}'))), ',') AS markers, {_n(inventories.SIGNATURE, 's')} AS n FROM k WHERE tab IS NOT NULL AND {_n(inventories.SIGNATURE, 's')} > 0",
    "seal_cells": f"WITH {_K}, {_seals('x', 'k')} SELECT * FROM x",
    "statute_counts": f"WITH {_K}, x AS (SELECT doc, t AS term, sum(len(string_split(s, t)) - 1) AS n FROM k, (VALUES ('LabourAct'), ('근로기준법')) AS v(t) GROUP BY 1, 2) SELECT doc, term, CAST(n AS BIGINT) AS n FROM x WHERE n > 0",
    "stencil_fragments": f"WITH {_K}, x AS (SELECT doc, regexp_replace(unnest(regexp_split_to_array(text, '[ ]{{3,}}|_{{2,}}|[:：]')), '\\s', '', 'g') AS fragment FROM k) SELECT DISTINCT doc, fragment FROM x WHERE length(fragment) >= 6",
    "party_values": f"WITH {_K}, {_PARTY} SELECT * FROM v",
    "consent_groups": f"WITH {_K}, {_groups('x', 'k')} SELECT * FROM x",
    "consent_findings": f"""WITH {_K}, {_B}, {_groups('x', 'k')}, {_groups('y', 'b')}, {_Z}, a AS (SELECT doc, count(*) AS g, sum(options) AS o FROM x GROUP BY 1), c AS (SELECT doc, count(*) AS g, sum(options) AS o FROM y GROUP BY 1), d AS (SELECT z.doc, state, c.g - coalesce(a.g, 0) AS g, c.o - coalesce(a.o, 0) AS o FROM z JOIN c ON c.doc = z.doc LEFT JOIN a ON a.doc = z.doc)
        SELECT x.doc, state, 'consent_unmarked' AS code, CASE WHEN required AND state = 'final' THEN 'HARD' ELSE 'WARN' END AS severity, count(*) AS n FROM x JOIN z ON z.doc = x.doc WHERE basis = 'glyphs' AND marked = 0 AND state <> 'blank' GROUP BY 1, 2, 4
        UNION ALL SELECT doc, state, 'consent_group_lost', 'HARD', CAST(g AS BIGINT) FROM d WHERE g > 0 UNION ALL SELECT doc, state, 'consent_option_lost', 'HARD', CAST(o AS BIGINT) FROM d WHERE o > 0""",
    "seal_findings": f"WITH {_K}, {_B}, {_seals('x', 'k')}, {_seals('y', 'b')} SELECT y.doc, CASE WHEN x.doc IS NULL THEN 'seal_removed' ELSE 'seal_written' END AS code, 'HARD' AS severity, count(*) AS n FROM y LEFT JOIN x ON x.doc = y.doc AND x.tab = y.tab AND x.seat = y.seat WHERE x.doc IS NULL OR x.residue <> y.residue GROUP BY 1, 2",
    "party_findings": f"WITH {_K}, {_B}, {_PARTY}, {_Z}, q AS (SELECT doc, seat, bool_or(value <> '') FILTER (label = 'owner') AS f, bool_or(value <> '') FILTER (label = 'worker') AS g FROM v GROUP BY doc, tab, seat) SELECT q.doc, 'party_one_sided' AS code, CASE WHEN state = 'final' THEN 'HARD' ELSE 'WARN' END AS severity, count(*) AS n FROM q JOIN z ON z.doc = q.doc WHERE f <> g GROUP BY 1, 3",
    "grant_gate": _gate_sql(inventories.GRANT, state=_STATE),
    "staff_gate": _gate_sql(inventories.STAFF, state=_MARKED_STATE),
    "petition_gate": _gate_sql(inventories.PETITION, _AT_WRITTEN, _MARKED_STATE),
    "official_gate": _gate_sql(inventories.OFFICIAL, state="CASE WHEN now.notes = 0 THEN 'final' WHEN coalesce(written, 0) > 0 THEN 'draft' ELSE 'blank' END"),
    "spacing_outliers": f"""WITH {_L}, {_O}, g AS (SELECT *, lead(y0) OVER p AS z0, lead(size) OVER p AS zs, lead(text) OVER p AS zt, lead(y0) OVER p - y1 AS gap FROM n WINDOW p AS (PARTITION BY doc, page ORDER BY y0, y1, text, size)),
        m AS (SELECT doc, page, median(gap) FILTER (gap > 0) AS median, count(*) FILTER (gap > 0) AS gaps, count(*) AS lines, median(size) AS ms, median(y1 - y0) AS lh FROM g GROUP BY 1, 2)
        SELECT doc, page, y1 AS "at", gap, round(median, 1) AS median FROM g JOIN m USING (doc, page) WHERE lines >= 3 AND gaps >= 2 AND gap > 1.8::DOUBLE * median AND NOT zs > 1.15::DOUBLE * ms AND NOT (regexp_matches(zt, '{layout.FOOTER}') AND z0 >= 160 * 0.92::DOUBLE) AND NOT regexp_matches(text, '{layout.OBJECT_CAPTION}') AND y1 < 160 * 0.88::DOUBLE
        AND NOT EXISTS (SELECT 1 FROM o WHERE o.doc = g.doc AND o.page = g.page AND o.y0 - CASE WHEN kind = 'table' THEN lh ELSE 0 END < z0 AND o.y1 + CASE WHEN kind = 'table' THEN lh ELSE 0 END > g.y1)""",
    "figure_faults": f"""WITH {_L}, {_O}, i AS (SELECT * FROM o WHERE kind = 'image')
        SELECT doc, page, figure, 'figure_width' AS kind FROM i WHERE NOT ((x1 - x0) / 500 BETWEEN 0.45::DOUBLE AND 0.95::DOUBLE)
        UNION ALL SELECT doc, page, figure, 'figure_overlap' FROM i WHERE EXISTS (SELECT 1 FROM n WHERE n.page = i.page AND text <> 'R' AND i.x0 < 400 AND i.x1 > 300 AND i.y0 < n.y1 AND i.y1 > n.y0)
        UNION ALL SELECT doc, page, figure, 'caption_missing' FROM i WHERE NOT coalesce((SELECT regexp_matches(arg_min(text, (y0, y1, text)), '{layout.CAPTION}') FROM n WHERE n.page = i.page AND n.y0 BETWEEN i.y1 AND i.y1 + 60), false) AND NOT coalesce((SELECT regexp_matches(arg_max(text, (y0, y1, text)), '{layout.CAPTION}') FROM n WHERE n.page = i.page AND n.y1 <= i.y0), false)""",
    "header_blanks": f"""WITH c AS (SELECT l_orderkey AS doc, CAST(0 AS BIGINT) AS tab, CAST((l_linenumber - 1) // 3 AS BIGINT) AS row, CAST((l_linenumber - 1) % 3 AS BIGINT) AS col, trim(max({_CELL_TEXT})) AS t FROM lineitem GROUP BY l_orderkey, l_linenumber),
        e AS (SELECT *, min(row) OVER w AS top, max(row) OVER w AS bottom FROM c WINDOW w AS (PARTITION BY doc, tab)),
        h AS (SELECT *, last_value(CASE WHEN t <> '' THEN t END IGNORE NULLS) OVER (PARTITION BY doc, tab ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, count(*) FILTER (t <> '') OVER v AS printed, count(*) FILTER (t = '') OVER v AS empty, min(col) OVER v AS first FROM e WHERE row = top AND top < bottom WINDOW v AS (PARTITION BY doc, tab))
        SELECT DISTINCT doc, tab, CAST(NULL AS BIGINT) AS col, CAST(NULL AS VARCHAR) AS label, 'blank_band' AS pattern FROM h WHERE printed = 0
        UNION ALL SELECT h.doc, h.tab, h.col, coalesce(l, CASE WHEN c.t <> '' THEN c.t END), CASE WHEN empty = 1 AND h.col = first AND c.t <> '' THEN 'stub_head' END FROM h LEFT JOIN c ON c.doc = h.doc AND c.row = h.top + 1 AND c.col = h.col WHERE printed > 0 AND h.t = ''""",
    "layout_verdicts": f"""WITH p AS (SELECT {_MEASURE} FROM lineitem GROUP BY 1, 2), q AS (SELECT *, max(page) OVER (PARTITION BY doc) AS last FROM p),
        d AS (SELECT doc, count(*) AS pages, sum(figures) AS shown, coalesce(max(white) FILTER (page < last AND white > 0), 0) AS w, max((white, -page)) FILTER (page < last AND white > 0) AS wp, coalesce(max(gap) FILTER (gap > 0), 0) AS g, max((gap, -page)) FILTER (gap > 0) AS gp FROM q GROUP BY 1)
        SELECT doc, pages, round(CAST(w AS DOUBLE), 1) AS worst_white, CAST(-wp[2] AS BIGINT) AS white_page, CAST(g AS DOUBLE) AS worst_gap, CAST(-gp[2] AS BIGINT) AS gap_page, CASE WHEN pages BETWEEN 5 AND 60 AND shown >= 2 AND w <= 25 AND g <= 3 THEN 'converged' WHEN pages > 60 THEN 'overfilled' WHEN pages < 5 OR shown < 2 OR w > 25 THEN 'underfilled' ELSE 'gappy' END AS state,
        concat_ws(',', CASE WHEN shown < 2 THEN 'add_figures' END, CASE WHEN pages < 5 OR w > 25 THEN 'expand' END, CASE WHEN pages > 60 THEN 'tighten' END, CASE WHEN g > 3 THEN 'remove_gap' END) AS needs FROM d""",
    "format_faults": f"""WITH s AS (SELECT {_STYLE} FROM lineitem), m AS (SELECT {_MARGIN} FROM orders WHERE {_MARGINS}), p AS (SELECT doc, count(*) FILTER (height = 1000) AS body, count(*) FILTER (colour = 'D02010') AS red, count(*) FILTER (bold) AS bolds, count(*) FILTER (spacing = 160) AS spaced FROM s GROUP BY 1),
        r AS (SELECT p.*, CASE WHEN m.doc IS NULL THEN 1 ELSE CAST(left_margin IS NULL OR abs(left_margin - 1701) > 2 AS INTEGER) + CAST(abs(top_margin - 2000) > 2 AS INTEGER) END AS off, CASE WHEN m.pages > 6 THEN 1 ELSE 0 END AS out FROM p LEFT JOIN m ON m.doc = p.doc)
        SELECT doc, code, severity, CAST(n AS BIGINT) AS n FROM (SELECT doc, 'F1' AS code, 'HARD' AS severity, CAST(body = 0 AS INTEGER) AS n FROM r UNION ALL SELECT doc, 'F2', 'HARD', red FROM r UNION ALL SELECT doc, 'F3', 'HARD', off FROM r UNION ALL SELECT doc, 'F4', 'HARD', out FROM r UNION ALL SELECT doc, 'F5', 'HARD', CAST(spaced = 0 AS INTEGER) FROM r UNION ALL SELECT doc, 'W3', 'WARN', bolds FROM r) WHERE n > 0""",
    "conversion_faults": """WITH k AS (SELECT page_id AS key, regexp_extract_all(lower(coalesce(html, '')), '<([a-z][a-z0-9]*)', 1) AS a FROM pages), p AS (SELECT key, a, CASE WHEN key % 3 = 0 THEN list_reverse(a) WHEN key % 5 = 1 THEN a[1:greatest(len(a) - 1, 0)] ELSE a END AS b FROM k)
        SELECT key, CASE WHEN list_sort(a) <> list_sort(b) THEN 'content_differs' ELSE 'order_drift' END AS code FROM p WHERE a <> b""",
    "pointer_faults": f"""WITH q AS (SELECT c_custkey AS ws, trim({_POINTER.format(string='VARCHAR')}) AS name FROM customer), r AS (SELECT ws, CASE WHEN lower(name) NOT IN ('', 'null', 'none', '~') THEN name END AS name FROM q)
        SELECT ws, 'canonical_null_after_done' AS code FROM r WHERE name IS NULL AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = ws AND o_orderkey % 9 >= 6 AND o_orderstatus = 'F')
        UNION ALL SELECT ws, 'canonical_target_missing' FROM r WHERE name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = ws AND 'o' || (o_orderkey % 10) = name)""",
}
