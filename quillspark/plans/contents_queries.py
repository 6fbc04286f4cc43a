"""Queries on marked-up reports, rules, schemas, catalogues and manifests, with the SQL that they equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contents
from ..sources.tables import read_table
from . import documents_queries
from .fixtures import FORBIDDEN, literal, private, reports, values
from .shared import scan_partitions

MARKED = [
    (-21, 'lost words\n[[FIG path="a.png"]]\n## SECTION: One \nfirst line\n  second line\n\nthird\n[[FIG path="b c.png" width=80 wide caption="x=y"]]\nafter\n[[TABLE caption="Sums" caption=Last]]\na | b\n\n1 | 2\n[[/TABLE]]\nend'),
    (-22, "## SECTION: Two\n[[NOTE a]]\n[[EQ id=e1]]\n## SECTION: Three\n[[URL href=http://x.org/?a=1]]\ntext [[EQ]] inside"),
    (-23, "We met The Royal Society of London. Alone it stood. Use `code x` and `code x`; Grand Old Duke Of York Town. 서울대학교 and 한국물리학회. And Paris!"),
]
TABLES = [(-31, "| symptom | remedy |\n|---|---|\n| slow | index |\n| lost | |\n\n| other | head |\n| slow | index |\n| odd | a | b |"), (-32, "| slow | index |\n| slow | index |")]
STOP = ["We", "Use", "And", "The"]
RULES = [("ends", "[.]", 40), ("the", "(?i)\\bthe\\b", 30), ("quote", "\"", 0), ("title", contents.title_pattern("Report {n}: {name}."), 0)]
SCHEMA = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer"}, "level": {"type": "string", "enum": ["low", "high"]}, "tags": {"type": "array", "items": {"type": "string"}}}}
#: JSON texts that stand for those of one event in eight, and what breaks the schema in them.
BROKEN = [(0, '{"k": "x"}', ["$.k: type integer"]), (1, '{"k": 1.5, "z": 1}', ["$.k: type integer", "$.z: additional"]), (2, "[1]", ["$: type object"]), (3, '{"tags": ["a", 3]}', ["$.k: missing", "$.tags[1]: type string"]), (4, "{", ["$: no JSON"]), (5, '{"k": 5, "level": "odd"}', ["$.level: enum"]), (6, '{"k": 5, "level": "low", "tags": []}', [])]


def _marked(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.unionByName(spark.createDataFrame(MARKED + TABLES, "doc_id long, text string"))


def content_blocks(spark, sf_dir):
    return contents.content_blocks(_marked(spark, sf_dir), scan_partitions(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def tag_attributes(spark, sf_dir):
    return contents.tag_attributes(content_blocks(spark, sf_dir))


def entities(spark, sf_dir):
    return contents.entities(_marked(spark, sf_dir), STOP)


def phrase_caps(spark, sf_dir):
    return contents.phrase_caps(read_table(spark, sf_dir, "documents"), RULES)


def schema_errors(spark, sf_dir):
    cases = " ".join(f"WHEN {i} THEN {literal(t)}" for i, t, _ in BROKEN)
    return contents.schema_errors(read_table(spark, sf_dir, "events").selectExpr("event_id", f"CASE event_id % 8 {cases} ELSE props END AS json"), "event_id", "json", SCHEMA)


def package_fingerprints(spark, sf_dir):
    return contents.fingerprints(documents_queries.package_blocks(spark, sf_dir), "page_id")


_BLOCK = "conv_id AS doc, turn AS seq, CASE (conv_id + turn * 2) % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'picture' ELSE 'paragraph' END AS kind, CASE WHEN turn % 3 = 1 THEN concat('Fig ', role) ELSE role END AS text"


def attached_captions(spark, sf_dir):
    return contents.attached_captions(read_table(spark, sf_dir, "conversations").selectExpr(*documents_queries._columns(_BLOCK)), "^Fig ")


_RECORD = "CASE p_partkey % 7 WHEN 0 THEN '{' WHEN 1 THEN concat('{\"doi\": \"10.1/P(', CAST(p_partkey + 1 AS {string}), ')\", \"title\": \"t\"}') WHEN 2 THEN concat('{\"doi\": \"10.1/p(', CAST(p_partkey AS {string}), ')\", \"title\": \" \"}') WHEN 3 THEN concat('{\"doi\": \"10.1/P(', CAST(p_partkey AS {string}), ')\", \"title\": \"t\"}') ELSE concat('{\"doi\": \"10.1/P(', CAST(p_partkey AS {string}), ')\", \"title\": \"t\", \"url\": \"u\", \"sha256\": \"', repeat('0a', 32), '\", \"fetched_at\": \"2024\"}') END"


def cached_sources(spark, sf_dir):
    # and one that no record is kept of
    cited = read_table(spark, sf_dir, "lineitem").select("l_partkey").unionByName(spark.createDataFrame([(-5,)], "l_partkey long")).selectExpr("'doi' AS kind", "concat('10.1/P(', l_partkey, ')') AS key")
    cache = read_table(spark, sf_dir, "part").selectExpr("'doi' AS kind", "concat('10.1_p_', p_partkey, '_') AS slug", f"{_RECORD.replace('{string}', 'string')} AS record")
    return contents.cached_sources(cited, cache)


def module_faults(spark, sf_dir):
    part, lines = read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "lineitem")
    modules = part.selectExpr("concat('m', p_partkey - CASE WHEN p_partkey % 41 = 0 THEN 1 ELSE 0 END) AS module", "CASE WHEN p_partkey % 23 = 0 THEN '1.x' ELSE concat('1.', p_size, '.0') END AS version")
    needs = lines.selectExpr("concat('m', l_partkey) AS module", "concat('m', l_suppkey + CASE WHEN l_linenumber = 7 THEN 100000000 ELSE 0 END) AS needs", "concat('1.', l_linenumber * 9, '.0') AS least")
    payloads = part.selectExpr("concat('m', p_partkey) AS module", "concat(p_name, p_size % 7) AS name")
    return contents.module_faults(modules, needs, payloads)


_MANIFEST = "CASE o_orderkey % 4 WHEN 0 THEN concat('{\"a/', CAST(o_custkey AS {string}), '\": \"ff\", \"b\": 3}') WHEN 1 THEN concat('{\"files\": [{\"path\": \"c\", \"sha256\": \"', o_orderstatus, '\"}, {\"path\": \"d\"}]}') WHEN 2 THEN '[{\"path\": \"e\", \"sha256\": \"00\"}, {\"sha256\": \"11\"}]' ELSE 'none' END"


def manifest_entries(spark, sf_dir):
    return contents.manifest_entries(read_table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_MANIFEST.replace('{string}', 'string')} AS json"), "o_orderkey", "json")


def feedback_rows(spark, sf_dir):
    return contents.feedback_rows(_marked(spark, sf_dir))


_VALUE = "l_orderkey AS doc, concat(l_returnflag, ' ', CAST(CAST(l_quantity AS bigint) AS {string})) AS value, l_linenumber % 2 = 0 AS wanted"
_HELD = "l_orderkey AS doc, concat('x ', l_returnflag, CAST(CAST(l_quantity + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS bigint) AS {string}), ' y') AS text"


def fill_presence(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem")
    row = lambda text: lines.selectExpr(*documents_queries._columns(text.format(string="string")))
    return contents.fill_presence(row(_VALUE), row(_HELD))


def content_audit(spark, sf_dir):
    docs = reports(spark, private(spark, read_table(spark, sf_dir, "documents")))
    return contents.content_audit(docs, [x for (x,) in FORBIDDEN], '"[^"\n]*"', RULES)


QUERIES = {
    "content_blocks": content_blocks,
    "tag_attributes": tag_attributes,
    "entities": entities,
    "phrase_caps": phrase_caps,
    "schema_errors": schema_errors,
    "package_fingerprints": package_fingerprints,
    "attached_captions": attached_captions,
    "cached_sources": cached_sources,
    "module_faults": module_faults,
    "manifest_entries": manifest_entries,
    "feedback_rows": feedback_rows,
    "fill_presence": fill_presence,
    "content_audit": content_audit,
}

_MARKED_SQL = f"(SELECT doc_id, text FROM documents UNION ALL SELECT CAST(doc_id AS BIGINT), text FROM {values(MARKED + TABLES, 'doc_id, text')})"
_SPLIT = "regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')"
_LINES = f"l AS (SELECT doc_id, unnest(x) AS raw, CAST(unnest(range(1, len(x) + 1)) AS INTEGER) AS line FROM (SELECT doc_id, {_SPLIT} AS x FROM {_MARKED_SQL} WHERE text IS NOT NULL))"
_BLOCKS = f"""{_LINES}, r AS (SELECT doc_id, line, trim(raw, ' ') AS text, nullif(regexp_extract(raw, '{contents.SECTION}', 1), '') AS head, nullif(regexp_extract(trim(raw, ' '), '^\\[\\[(/?[A-Za-z]+)(.*)\\]\\]$', 1), '') AS tag, trim(regexp_extract(trim(raw, ' '), '^\\[\\[(/?[A-Za-z]+)(.*)\\]\\]$', 2), ' ') AS rest FROM l),
    k AS (SELECT *, CASE WHEN head IS NOT NULL THEN 'head' WHEN tag IS NOT NULL THEN 'tag' WHEN text = '' THEN 'blank' ELSE 'text' END AS k FROM r),
    p AS (SELECT *, last_value(head IGNORE NULLS) OVER w AS section, sum(CASE tag WHEN 'TABLE' THEN 1 WHEN '/TABLE' THEN -1 ELSE 0 END) OVER w AS open, sum(CAST(k <> 'text' AS INTEGER)) OVER w AS part FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT doc_id, min(line) AS line, section, 'para' AS kind, string_agg(text, ' ' ORDER BY line) AS text FROM p WHERE k = 'text' AND open <= 0 AND section IS NOT NULL GROUP BY doc_id, section, part
        UNION ALL SELECT doc_id, line, section, CASE WHEN ltrim(tag, '/') NOT IN ('EQ', 'FIG', 'TABLE', 'URL') THEN 'unknown_tag' WHEN section IS NULL THEN 'tag_outside' ELSE lower(tag) END, rest FROM p WHERE k = 'tag' AND NOT starts_with(tag, '/')
        UNION ALL SELECT doc_id, line, section, 'row', text FROM p WHERE k = 'text' AND open > 0 AND section IS NOT NULL)"""
_ATTRIBUTE = contents.ATTRIBUTE
_CAPITAL = contents.CAPITAL.replace("'", "''")
_STOPPED = ", ".join(map(literal, STOP))
_COUNTED = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS rule, CAST(len(regexp_extract_all(coalesce(text, ''), {literal(pattern)})) AS BIGINT) AS n FROM documents WHERE len(regexp_extract_all(coalesce(text, ''), {literal(pattern)})) > {most}" for name, pattern, most in RULES)
_ERRORS = ", ".join(f"({i}, {literal(e)})" for i, _, errors in BROKEN for e in errors)

ORACLE_SQL = {
    "content_blocks": f"WITH {_BLOCKS} SELECT * FROM c",
    "tag_attributes": f"""WITH {_BLOCKS}, a AS (SELECT doc_id, line, regexp_extract_all(text, '{_ATTRIBUTE}') AS w, regexp_extract_all(text, '{_ATTRIBUTE}', 1) AS n, regexp_extract_all(text, '{_ATTRIBUTE}', 2) AS q, regexp_extract_all(text, '{_ATTRIBUTE}', 3) AS p FROM c WHERE kind NOT IN ('para', 'row')),
        e AS (SELECT doc_id, line, unnest(range(len(w))) AS at_, unnest(w) AS w, unnest(n) AS key, unnest(q) AS q, unnest(p) AS p FROM a) SELECT doc_id, line, key, CASE WHEN contains(w, '=') THEN coalesce(q, '') || coalesce(p, '') END AS value FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, line, key ORDER BY at_ DESC) = 1""",
    "entities": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM {_MARKED_SQL}), m AS (SELECT doc_id, regexp_extract_all(text, '`([^`\\n]+)`', 1) AS a, regexp_extract_all(text, '{_CAPITAL}', 1) AS b, regexp_extract_all(text, '{_CAPITAL}', 2) AS c, regexp_extract_all(text, '{contents.INSTITUTION}') AS i FROM d),
        x AS (SELECT doc_id, 'code' AS kind, unnest(a) AS name, unnest(range(len(a))) AS at_, 'x' AS before FROM m UNION ALL SELECT doc_id, 'capital', unnest(c), unnest(range(len(c))), unnest(b) FROM m UNION ALL SELECT doc_id, 'institution', unnest(i), unnest(range(len(i))), 'x' FROM m)
        SELECT doc_id, kind, name, count(*) AS n, min(at_) AS first FROM x WHERE NOT (kind = 'capital' AND (name IN ({_STOPPED}) OR (NOT contains(name, ' ') AND regexp_matches(coalesce(before, ''), '^$|^[.!?]')))) GROUP BY 1, 2, 3""",
    "phrase_caps": _COUNTED,
    "schema_errors": f"SELECT event_id, e AS error FROM events JOIN (VALUES {_ERRORS}) AS v(i, e) ON event_id % 8 = i",
    "package_fingerprints": f"""WITH b AS ({documents_queries.ORACLE_SQL['package_blocks']}) SELECT page_id, sha256(string_agg(regexp_replace(text, '\\s', '', 'g'), '' ORDER BY member, seq)) AS text_digest,
        sha256(string_agg(concat_ws(':', kind, coalesce(CAST(tab AS VARCHAR), '-'), coalesce(CAST(depth AS VARCHAR), '-'), coalesce(CAST(row AS VARCHAR), '-'), coalesce(CAST(col AS VARCHAR), '-'), coalesce(CAST(row_span AS VARCHAR), '-'), coalesce(CAST(col_span AS VARCHAR), '-')), '|' ORDER BY member, seq)) AS shape_digest, count(*) FILTER (kind = 'cell') AS cells, count(*) FILTER (kind = 'equation') AS equations, count(*) FILTER (kind = 'picture') AS pictures FROM b GROUP BY 1""",
    "attached_captions": f"""WITH b AS (SELECT {_BLOCK} FROM conversations), w AS (SELECT *, kind = 'paragraph' AND regexp_matches(text, '^Fig ') AS here FROM b), n AS (SELECT *, lag(kind) OVER p AS before, lead(here) OVER p AS follows, lead(text) OVER p AS next_text FROM w WINDOW p AS (PARTITION BY doc ORDER BY seq))
        SELECT doc, seq, kind, text, CASE WHEN kind <> 'paragraph' AND follows THEN next_text END AS caption FROM n WHERE NOT (here AND coalesce(before <> 'paragraph', false))""",
    "cached_sources": "SELECT 'doi' AS kind, '10.1/P(' || k || ')' AS key, CASE WHEN p_partkey IS NULL THEN 'absent' WHEN p_partkey % 7 = 0 THEN 'unreadable' WHEN p_partkey % 7 = 1 THEN 'mismatch' WHEN p_partkey % 7 = 2 THEN 'untitled' WHEN p_partkey % 7 = 3 THEN 'unverified' ELSE 'verified' END AS state FROM (SELECT DISTINCT l_partkey AS k FROM lineitem UNION SELECT -5) LEFT JOIN part ON p_partkey = k",
    "module_faults": """WITH m AS (SELECT 'm' || (p_partkey - CASE WHEN p_partkey % 41 = 0 THEN 1 ELSE 0 END) AS module, p_partkey % 23 = 0 AS odd, p_size FROM part), h AS (SELECT module, max(p_size) FILTER (NOT odd) AS have FROM m GROUP BY 1),
        n AS (SELECT 'm' || l_partkey AS module, 'm' || (l_suppkey + CASE WHEN l_linenumber = 7 THEN 100000000 ELSE 0 END) AS needs, l_linenumber * 9 AS least FROM lineitem), p AS (SELECT DISTINCT 'm' || p_partkey AS module, p_name || (p_size % 7) AS name FROM part)
        SELECT module, 'duplicate' AS code, CAST(count(*) AS VARCHAR) AS detail FROM m GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT module, 'version', '1.x' FROM m WHERE odd
        UNION ALL SELECT DISTINCT n.module, CASE WHEN h.module IS NULL THEN 'missing' ELSE 'too_old' END, needs FROM n LEFT JOIN h ON h.module = needs WHERE h.module IS NULL OR have IS NULL OR have < least
        UNION ALL SELECT module, 'collision', name FROM p WHERE name IN (SELECT name FROM p GROUP BY 1 HAVING count(*) > 1)""",
    "manifest_entries": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a/' || o_custkey WHEN 1 THEN 'c' ELSE 'e' END AS path, CASE o_orderkey % 4 WHEN 0 THEN 'ff' WHEN 1 THEN o_orderstatus ELSE '00' END AS digest FROM orders WHERE o_orderkey % 4 < 3",
    "feedback_rows": f"""WITH {_LINES}, t AS (SELECT doc_id, line, list_transform(string_split(regexp_replace(trim(raw, ' '), '^\\||\\|$', '', 'g'), '|'), lambda x: trim(x, ' ')) AS c, lag(line) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM l WHERE starts_with(raw, '|')),
        s AS (SELECT doc_id, line, c[1] AS symptom, c[2] AS remedy FROM t WHERE before = line - 1 AND len(c) >= 2 AND NOT regexp_matches(c[1], '^:?-{{2,}}:?$') AND c[1] <> '' AND c[2] <> '') SELECT sha256(symptom || chr(31) || remedy) AS id, arg_min(doc_id, (doc_id, line)) AS doc_id, arg_min(line, (doc_id, line)) AS line, symptom, remedy FROM s GROUP BY symptom, remedy""",
    "fill_presence": f"""WITH v AS (SELECT DISTINCT {_VALUE.format(string='VARCHAR')} FROM lineitem), h AS (SELECT {_HELD.format(string='VARCHAR')} FROM lineitem), x AS (SELECT *, EXISTS (SELECT 1 FROM h WHERE h.doc = v.doc AND contains(replace(text, ' ', ''), replace(value, ' ', ''))) AS held FROM v)
        SELECT doc, value, CASE WHEN wanted THEN 'missing' ELSE 'kept' END AS code FROM x WHERE wanted <> held""",
}
