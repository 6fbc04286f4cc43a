"""The registered queries of the reference operators over the driver tables, each beside the DuckDB SQL that it equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, privacy, relational, reuse, state, text
from ..sources.tables import read_table
from . import claims_queries, contents_queries, documents_queries, evidence_queries, forms_queries, packs_queries, preflight_queries, spans_queries, trees_queries, workflow_queries
from .fixtures import MODULES, PRIVATE_SQL, UNDEFINED, UNMET, private, values
from .shared import spread

TERMS = ["password", "license", "token"]


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [read_table(spark, sf_dir, n) for n in names]


def reused_passages(spark, sf_dir):
    docs, prior = _t(spark, sf_dir, "documents", "benchmark")
    return reuse.reused_passages(spread(docs.select("doc_id", "text")), prior)


def value_conflicts(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))
    return relational.value_conflicts(rows, ["l_partkey", "l_suppkey"], "unit_price", 0.01)


def dangling_refs(spark, sf_dir):
    items, parts = _t(spark, sf_dir, "lineitem", "part")
    refs = items.select("l_partkey").unionByName(spark.createDataFrame(UNDEFINED, "l_partkey long"))
    return relational.dangling(refs, parts, "l_partkey", "p_partkey")


def unreferenced(spark, sf_dir):
    orders, items = _t(spark, sf_dir, "orders", "lineitem")
    return relational.unreferenced(orders, "o_orderkey", items, "l_orderkey")


def backed_numbers(spark, sf_dir):
    orders, items = _t(spark, sf_dir, "orders", "lineitem")
    return relational.backed(orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value")), items.select(F.col("l_extendedprice").alias("result")))


def total_checks(spark, sf_dir):
    orders, items = _t(spark, sf_dir, "orders", "lineitem")
    return relational.total_checks(orders.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("stated")), items.select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("amount")), 0.2)


def running_total(spark, sf_dir):
    return relational.running_total(read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("line"), F.length("text").cast("double").alias("amount")))


def numbering_gaps(spark, sf_dir):
    return relational.numbering_gaps(read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("number")))


def style_mode(spark, sf_dir):
    return relational.mode(read_table(spark, sf_dir, "events"), "user_id", "event_type")


def nearest_rank(spark, sf_dir):
    return relational.nearest_rank(read_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")


def record_differences(spark, sf_dir):
    customers, suppliers = _t(spark, sf_dir, "customer", "supplier")
    return relational.record_differences(customers.select(F.col("c_custkey").alias("idx"), F.col("c_nationkey").alias("record")), suppliers.select(F.col("s_suppkey").alias("idx"), F.col("s_nationkey").alias("record")))


def multiset_difference(spark, sf_dir):
    customers, suppliers = _t(spark, sf_dir, "customer", "supplier")
    return relational.multiset_difference(customers.select(F.col("c_nationkey").alias("value")), suppliers.select(F.col("s_nationkey").alias("value")))


def score_rollup(spark, sf_dir):
    labels, docs = _t(spark, sf_dir, "labels", "documents")
    return relational.score_rollup(labels, docs)


def unique_word_pairs(spark, sf_dir):
    docs, items = _t(spark, sf_dir, "documents", "benchmark")
    return relational.unique_word_pairs(docs, items)


def overlapping_intervals(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("group"), F.unix_date(F.to_date("l_shipdate")).alias("start"), (F.unix_date(F.to_date("l_shipdate")) + F.col("l_quantity").cast("int")).alias("end"))
    return relational.overlapping(rows)


def maximal_terms(spark, sf_dir):
    return relational.maximal_terms(read_table(spark, sf_dir, "part").select(F.col("p_name").alias("term")).unionByName(read_table(spark, sf_dir, "region").select(F.lower("r_name").alias("term"))).unionByName(spark.createDataFrame([("small",), ("ring",), ("asia",)], "term string")).distinct())


def title_coverage(spark, sf_dir):
    items, docs = _t(spark, sf_dir, "benchmark", "documents")
    return text.title_coverage(items, spread(docs.select("doc_id", "text")))


def rolled_up(spark, sf_dir):
    return privacy.verdicts(privacy.counted_findings(private(spark, spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))), TERMS))


GATES = {"k_known": "k >= 0", "k_small": "k < 90", "k_fifty": "k == 50"}


def rule_states(spark, sf_dir):
    docs = private(spark, read_table(spark, sf_dir, "documents"))
    rules = spark.createDataFrame([("email",), ("denied_term",), ("user_path",)], "rule string")
    return gates.rule_states(rules, privacy.findings(docs, TERMS))


def next_cells(spark, sf_dir):
    return relational.next_cells(read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("table"), F.col("turn").alias("col"), F.col("role").alias("text")))


def vocabulary_differences(spark, sf_dir):
    docs, items = _t(spark, sf_dir, "documents", "benchmark")
    return relational.vocabulary_differences(docs, items)


def first_qualifying(spark, sf_dir):
    return relational.first_qualifying(read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line")).agg(F.max("l_quantity").alias("value")), 40.0)


def box_overlaps(spark, sf_dir):
    x, y = F.col("l_partkey") % 60, F.col("l_extendedprice").cast("long") % 60
    rows = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("page"), x.alias("x0"), y.alias("y0")).agg(F.max("l_quantity").cast("long").alias("q"))
    return relational.unit_overlaps(rows.selectExpr("page", "x0 * 100 + y0 AS id", "x0", "y0", "x0 + 1 + q % 9 AS x1", "y0 + 1 + q % 5 AS y1"))


def missing_requirements(spark, sf_dir):
    customers, suppliers = _t(spark, sf_dir, "customer", "supplier")
    owners = customers.selectExpr("c_mktsegment AS owner", "c_nationkey AS item").unionByName(spark.createDataFrame(UNMET, "owner string, item int"))
    return relational.missing_requirements(owners, suppliers.selectExpr("s_nationkey AS item"))


def late_outputs(spark, sf_dir):
    orders, items = _t(spark, sf_dir, "orders", "lineitem")
    outputs = items.select(F.col("l_orderkey").alias("key"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("at"))
    return relational.late_outputs(outputs, orders.select(F.col("o_orderkey").alias("key"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at")), 60 * 86_400)


CODES = [("widget", "T1"), ("STEEL", "T2"), ("small", "T3"), ("economy", "T4")]


def _private(operator, *args):
    return lambda spark, sf_dir: operator(private(spark, read_table(spark, sf_dir, "documents")), *args)


def _on(table: str, operator, *args):
    return lambda spark, sf_dir: operator(read_table(spark, sf_dir, table), *args)


QUERIES = {
    "reused_passages": reused_passages,
    "repeated_texts": _on("documents", reuse.repeated_texts),
    "sentence_endings": _on("documents", text.ending_distribution),
    "repeated_tics": lambda spark, sf_dir: text.repeated_tics(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))),
    "length_statistics": _on("documents", text.length_statistics),
    "pivot_density": _on("documents", text.density, "[!?]"),
    "element_counts": _on("pages", text.element_counts),
    "element_slots": lambda spark, sf_dir: text.slots(text.element_counts(read_table(spark, sf_dir, "pages"))),
    "canonical_urls": _on("pages", text.urls),
    "checksums": lambda spark, sf_dir: text.checksum_rows(read_table(spark, sf_dir, "orders"), "o_orderkey"),
    "title_coverage": title_coverage,
    "emails": _on("documents", privacy.emails),
    "denied_terms": _on("documents", privacy.denied_terms, TERMS),
    "near_numbers": _on("documents", privacy.near_numbers),
    "findings_rollup": rolled_up,
    "value_conflicts": value_conflicts,
    "dangling_refs": dangling_refs,
    "unreferenced": unreferenced,
    "backed_numbers": backed_numbers,
    "total_checks": total_checks,
    "running_total": running_total,
    "numbering_gaps": numbering_gaps,
    "style_mode": style_mode,
    "nearest_rank": nearest_rank,
    "record_differences": record_differences,
    "multiset_difference": multiset_difference,
    "score_rollup": score_rollup,
    "unique_word_pairs": unique_word_pairs,
    "overlapping_intervals": overlapping_intervals,
    "maximal_terms": maximal_terms,
    "restart_sessions": _on("events", state.restarts),
    "forward_fill": _on("conversations", state.forward_fill),
    "answered_turns": _on("conversations", state.answered),
    "latest_events": _on("events", state.latest),
    "blocked_events": _on("events", state.blocked),
    "event_windows": _on("events", state.windows),
    "event_sessions": _on("events", state.sessions),
    "property_path": _on("events", state.property_path),
    "in_effect": _on("events", state.in_effect, "purchase"),
    "occurrence_ids": _on("events", state.occurrence_ids),
    "gate_results": _on("events", gates.gate_results, "props", GATES),
    "rule_states": rule_states,
    "next_cells": next_cells,
    "vocabulary_differences": vocabulary_differences,
    "first_qualifying": first_qualifying,
    "stale_users": _on("events", state.stale),
    "canonical_json": _on("events", gates.canonical_rows, "event_id", "props"),
    "paragraph_statistics": _on("documents", text.paragraph_statistics),
    "sentence_counts": _on("documents", text.sentence_counts),
    "tag_masks": _private(text.tag_masks),
    "bold_segments": _private(text.bold_segments),
    "heading_echoes": _private(text.heading_echoes, ["guide", "fill"]),
    "identity_numbers": _private(privacy.identity_numbers),
    "named_numbers": _private(privacy.named_numbers),
    "privacy_gate": _private(privacy.gate, TERMS),
    "box_overlaps": box_overlaps,
    "missing_requirements": missing_requirements,
    "late_outputs": late_outputs,
    "first_codes": lambda spark, sf_dir: relational.first_codes(read_table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "concat(p_name, ' ', p_type) AS text"), CODES),
    "module_levels": lambda spark, sf_dir: relational.level_order(spark.createDataFrame(MODULES, "module string, requires string")),
    "apportioned": lambda spark, sf_dir: relational.apportioned(read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("part")).agg(F.sum("l_quantity").cast("long").alias("ratio")).withColumn("total", F.lit(42520))),
    **claims_queries.QUERIES,
    **forms_queries.QUERIES,
    **workflow_queries.QUERIES,
    **documents_queries.QUERIES,
    **contents_queries.QUERIES,
    **evidence_queries.QUERIES,
    **spans_queries.QUERIES,
    **trees_queries.QUERIES,
    **packs_queries.QUERIES,
    **preflight_queries.QUERIES,
}

_LINES = "regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')"
_TOKENS = "regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+(?:[-''][\\p{{L}}\\p{{N}}]+)*')"
_PROSE = "flatten(list_filter(list_transform(list_filter({lines}, lambda x: NOT regexp_matches(x, '^\\s*(#|\\||[-=*_]{{3,}}\\s*$)')), lambda x: {tokens}), lambda x: len(x) >= 6))".format(lines=_LINES, tokens=_TOKENS.format("x"))
_GRAMS = "SELECT DISTINCT {key}, array_to_string(w[i:i+{n}-1], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w)-{n}+2)) AS i FROM {src})"

_PATHS = f"SELECT doc_id, name FROM (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, 'C:\\\\Users\\\\([^\\\\/\\s\"'']+)', 1), regexp_extract_all(text, '(?:^|[^A-Za-z0-9_.~-])/home/([^\\\\/\\s\"'']+)', 1))) AS name FROM {PRIVATE_SQL}) WHERE lower(name) NOT IN ('<user>', 'username', '%userprofile%', 'example', 'me')"
_PARTED = "FROM (SELECT source, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) AS p FROM documents) WHERE trim(p, ' ') <> '' AND NOT regexp_matches(p, '^\\s*(?:#|\\||<!--)')"

#: Lines as runs of digits and what lies between, so that the numbers follow from the rule by runs.
_DIGITS = f"""
        WITH l AS (SELECT r, doc_id, unnest(x) AS text, CAST(unnest(range(1, len(x) + 1)) AS INTEGER) AS line FROM (SELECT row_number() OVER () AS r, doc_id, {_LINES} AS x FROM {PRIVATE_SQL} WHERE text IS NOT NULL)),
        k AS (SELECT doc_id, line, regexp_extract_all(text, '[0-9]+|[^0-9]+') AS k FROM l WHERE contains(text, '-'))"""
_HYPHEN = "list_contains(['-', ' -', '- ', ' - '], {})"
_IDENTITIES = f"""
            SELECT doc_id, line, 'resident' AS kind, unnest(list_transform(list_filter(range(1, len(k) - 1), lambda i: regexp_full_match(k[i], '[0-9]{{6}}') AND {_HYPHEN.format("k[i + 1]")} AND regexp_full_match(k[i + 2], '[1-4][0-9]{{6}}')), lambda i: k[i] || k[i + 2])) AS number FROM k
            UNION ALL SELECT doc_id, line, 'phone', unnest(list_transform(list_filter(range(1, len(k) - 3), lambda i: regexp_full_match(k[i], '01[016789]') AND {_HYPHEN.format("k[i + 1]")} AND regexp_full_match(k[i + 2], '[0-9]{{3,4}}') AND {_HYPHEN.format("k[i + 3]")} AND regexp_full_match(k[i + 4], '[0-9]{{4}}')), lambda i: k[i] || k[i + 2] || k[i + 4])) FROM k"""
#: Pairs of runs of five digits and of two to four syllables by their places; a run's place is the length of all runs before.
_NEAR = """t AS (SELECT r, doc_id, line, text, unnest(p) AS p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, '[0-9]+|[가-힣]+|[^0-9가-힣]+') AS p FROM l WHERE regexp_matches(text, '[0-9]{5}') AND regexp_matches(text, '[가-힣]{2}'))),
        u AS (SELECT *, CAST(sum(length(p)) OVER (PARTITION BY r, line ORDER BY i) AS BIGINT) AS e FROM t),
        n AS (SELECT a.doc_id, a.line, a.text, least(a.e - length(a.p), b.e - length(b.p)) AS start, greatest(a.e, b.e) AS stop FROM u AS a JOIN u AS b ON a.r = b.r AND a.line = b.line WHERE regexp_full_match(a.p, '[0-9]{5}') AND regexp_full_match(b.p, '[가-힣]{2,4}') AND greatest(a.e - length(a.p), b.e - length(b.p)) - least(a.e, b.e) <= 12)"""

ORACLE_SQL: dict[str, str] = {
    "reused_passages": f"""
        WITH a AS (SELECT doc_id, {_PROSE} AS w FROM documents), b AS (SELECT item_id, {_PROSE} AS w FROM benchmark),
        a8 AS ({_GRAMS.format(key="doc_id", n=8, src="a")}), b8 AS ({_GRAMS.format(key="item_id", n=8, src="b")}),
        a12 AS ({_GRAMS.format(key="doc_id", n=12, src="a")}), b12 AS ({_GRAMS.format(key="item_id", n=12, src="b")}),
        s AS (SELECT doc_id, item_id, count(*) AS shared FROM a8 JOIN b8 USING (g) GROUP BY ALL),
        r AS (SELECT DISTINCT doc_id, item_id FROM a12 JOIN b12 USING (g)),
        na AS (SELECT doc_id, count(*) AS na FROM a8 GROUP BY 1), nb AS (SELECT item_id, count(*) AS nb FROM b8 GROUP BY 1),
        p AS (SELECT s.doc_id, s.item_id, shared, round(shared / (na + nb - shared), 6) AS jaccard, r.doc_id IS NOT NULL AS long_run
              FROM s JOIN na USING (doc_id) JOIN nb USING (item_id) LEFT JOIN r ON r.doc_id = s.doc_id AND r.item_id = s.item_id)
        SELECT * FROM p WHERE (jaccard >= 0.35 AND shared >= 4) OR long_run""",
    "repeated_texts": "SELECT sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "sentence_endings": """
        SELECT CASE right(trim(s), 1) WHEN '.' THEN 'period' WHEN '!' THEN 'exclamation' WHEN '?' THEN 'question' ELSE 'other' END AS ending, count(*) AS sentences
        FROM (SELECT unnest(regexp_extract_all(text, '[^.!?\\n]+[.!?]?')) AS s FROM documents) WHERE trim(s) <> '' GROUP BY 1""",
    "repeated_tics": f"""
        WITH a AS (SELECT doc_id, row_number() OVER () AS r, {_TOKENS.format("text")} AS w FROM documents),
        g AS (SELECT doc_id, array_to_string(w[i:i+n-1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w)-n+2)) AS i FROM a, (VALUES (2), (3)) v(n))),
        c AS (SELECT doc_id, phrase, count(*) AS uses FROM g GROUP BY ALL HAVING count(*) >= 3)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY uses DESC, length(phrase) DESC, phrase) AS INTEGER) AS rank, phrase, uses FROM c QUALIFY rank <= 8""",
    "length_statistics": f"""
        SELECT source, count(*) AS n_lines, min(n) AS least, max(n) AS most, round(avg(n), 2) AS mean, CAST(median(n) AS DOUBLE) AS median
        FROM (SELECT source, CAST(length(l) AS INTEGER) AS n FROM (SELECT source, unnest({_LINES}) AS l FROM documents) WHERE trim(l, ' ') <> '') GROUP BY 1""",
    "pivot_density": """
        SELECT doc_id, hits, round(rate, 4) AS per_10k, CASE WHEN rate >= 4.5 THEN 'HARD' WHEN rate >= 3.0 THEN 'WARN' ELSE 'OK' END AS severity
        FROM (SELECT doc_id, hits, CASE WHEN strlen(text) > 0 THEN hits * 10000.0::DOUBLE / strlen(text) ELSE 0.0::DOUBLE END AS rate
              FROM (SELECT doc_id, text, CAST(len(regexp_extract_all(text, '[!?]')) AS BIGINT) AS hits FROM documents WHERE text IS NOT NULL))""",
    "element_counts": "SELECT page_id, e AS element, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) AS e FROM pages) GROUP BY ALL",
    "element_slots": """
        WITH c AS (SELECT page_id, e AS element, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) AS e FROM pages) GROUP BY ALL)
        SELECT element, count(*) AS pages, count(DISTINCT n) AS n_values, CASE WHEN count(*) = (SELECT count(DISTINCT page_id) FROM c) AND count(DISTINCT n) = 1 THEN 'chrome' ELSE 'slot' END AS kind FROM c GROUP BY 1""",
    "canonical_urls": """
        SELECT page_id, CASE WHEN lower(s) IN ('http', 'https') AND h <> '' THEN lower(s) || '://' || lower(h) || r END AS url
        FROM (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS s, regexp_extract(url, '://([^/?#]*)', 1) AS h, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS r FROM pages)""",
    "checksums": """
        WITH k AS (SELECT o_orderkey AS code, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS t FROM orders),
        d AS (SELECT code, list_transform(range(1, 11), lambda i: CAST(t[i] AS INTEGER)) AS x FROM k)
        SELECT code, list_sum(list_transform(range(1, 11), lambda i: x[i] * (11 - i))) % 11 = 0 AS isbn10,
               (38 + list_sum(list_transform(range(1, 11), lambda i: x[i] * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END))) % 10 = 0 AS isbn13 FROM d""",
    "emails": """
        SELECT DISTINCT doc_id, email, starts_with(l, 'noreply') OR d = 'example.com' OR ends_with(d, '.example.com') OR ends_with(d, '.invalid') OR d = 'users.noreply.github.com' OR ends_with(d, '.users.noreply.github.com') AS exempt
        FROM (SELECT doc_id, email, lower(split_part(email, '@', 1)) AS l, lower(split_part(email, '@', 2)) AS d
              FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS email FROM documents))""",
    "denied_terms": f"""
        WITH l AS (SELECT doc_id, unnest(x) AS t, unnest(range(1, len(x) + 1)) AS line FROM (SELECT doc_id, {_LINES} AS x FROM documents WHERE text IS NOT NULL))
        SELECT doc_id, CAST(line AS INTEGER) AS line, term FROM l JOIN (VALUES ('password'), ('license'), ('token')) v(term) ON contains(lower(t), term)""",
    "near_numbers": f"""
        WITH l AS (SELECT doc_id, unnest(x) AS t, unnest(range(1, len(x) + 1)) AS line FROM (SELECT doc_id, {_LINES} AS x FROM documents WHERE text IS NOT NULL)),
        k AS (SELECT doc_id, line, regexp_extract_all(t, '[0-9]+|[^0-9]+') AS k FROM l WHERE regexp_matches(t, '[0-9]{{5}}'))
        SELECT doc_id, CAST(line AS INTEGER) AS line, len(list_filter(range(1, len(k) - 1), lambda i: regexp_full_match(k[i], '[0-9]{{5,}}') AND len(k[i + 1]) <= 12 AND regexp_full_match(k[i + 2], '[0-9]{{5,}}'))) AS pairs FROM k WHERE pairs > 0""",
    "findings_rollup": f"""
        WITH l AS (SELECT doc_id, unnest({_LINES}) AS t FROM {PRIVATE_SQL} WHERE text IS NOT NULL),
        m AS (SELECT DISTINCT doc_id, email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) AS email FROM {PRIVATE_SQL})),
        p AS ({_PATHS}),
        f AS (SELECT doc_id, CASE WHEN regexp_matches(lower(email), '^noreply|(@|\\.)example\\.com$|\\.invalid$|(@|\\.)users\\.noreply\\.github\\.com$') THEN 'WARN' ELSE 'HARD' END AS s FROM m
              UNION ALL SELECT doc_id, 'HARD' FROM p
              UNION ALL SELECT doc_id, 'HARD' FROM l JOIN (VALUES ('password'), ('license'), ('token')) v(term) ON contains(lower(t), term))
        SELECT d.doc_id, count(*) FILTER (s = 'HARD') AS hard, count(*) FILTER (s = 'WARN') AS warn, count(*) FILTER (s = 'HARD') = 0 AS ok,
               CAST(CASE WHEN count(*) FILTER (s = 'HARD') > 0 THEN 3 WHEN count(*) FILTER (s = 'WARN') > 0 THEN 2 ELSE 0 END AS INTEGER) AS exit_code
        FROM (SELECT DISTINCT doc_id FROM {PRIVATE_SQL}) d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY 1""",
    "value_conflicts": """
        SELECT l_partkey, l_suppkey, n, least, most, round((most - least) / greatest(abs(most), abs(least)), 6) AS difference
        FROM (SELECT l_partkey, l_suppkey, count(*) AS n, min(l_extendedprice / l_quantity) AS least, max(l_extendedprice / l_quantity) AS most FROM lineitem GROUP BY 1, 2)
        WHERE (most - least) / greatest(abs(most), abs(least)) > 0.01""",
    "dangling_refs": f"SELECT l_partkey AS ref, count(*) AS uses FROM (SELECT l_partkey FROM lineitem UNION ALL SELECT CAST(l_partkey AS BIGINT) FROM {values(UNDEFINED, 'l_partkey')}) WHERE l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY 1",
    "unreferenced": "SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "backed_numbers": """
        WITH r AS (SELECT DISTINCT l_extendedprice AS x FROM lineitem WHERE l_extendedprice > 0), a AS (SELECT o_orderkey, o_totalprice AS v, x AS low FROM orders ASOF LEFT JOIN r ON o_totalprice >= x), b AS (SELECT o_orderkey, x AS high FROM orders ASOF LEFT JOIN r ON o_totalprice <= x)
        SELECT o_orderkey AS id, v AS value, coalesce(v > 0 AND v - low <= 0.001::DOUBLE * v, false) OR coalesce(v > 0 AND high - v <= 0.001::DOUBLE * high, false) AS backed FROM a JOIN b USING (o_orderkey)""",
    "total_checks": """
        SELECT o_orderkey AS key, o_totalprice AS stated, round(s, 2) AS summed, abs(o_totalprice - s) <= 0.2::DOUBLE * greatest(o_totalprice, s) AS matches
        FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "running_total": "SELECT conv_id AS key, turn AS line, coalesce(sum(CAST(length(text) AS DOUBLE)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS above FROM conversations",
    "numbering_gaps": "SELECT l_orderkey AS key, count(DISTINCT l_linenumber) AS n, max(l_linenumber) AS last FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(DISTINCT l_linenumber)",
    "style_mode": "SELECT user_id AS key, event_type AS value, count(*) AS n FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) = 1",
    "nearest_rank": "SELECT l_returnflag AS key, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY 1",
    "record_differences": """
        SELECT coalesce(c_custkey, s_suppkey) AS idx, CASE WHEN c_nationkey IS NULL THEN 'added' WHEN s_nationkey IS NULL THEN 'missing' ELSE 'changed' END AS change
        FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey IS DISTINCT FROM s_nationkey""",
    "multiset_difference": "SELECT value, CAST(sum(n) AS BIGINT) AS surplus FROM (SELECT c_nationkey AS value, 1 AS n FROM customer UNION ALL SELECT s_nationkey, -1 FROM supplier) GROUP BY 1 HAVING sum(n) <> 0",
    "score_rollup": """
        SELECT lang, source, count(*) AS runs, count(*) FILTER (quality = 1) AS passed, CAST(sum(toxic) AS BIGINT) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source)""",
    "unique_word_pairs": f"""
        WITH a AS (SELECT w, min(doc_id) AS doc_id FROM (SELECT doc_id, unnest({_TOKENS.format("text")}) AS w FROM documents) GROUP BY 1 HAVING count(*) = 1),
        b AS (SELECT w, min(item_id) AS item_id FROM (SELECT item_id, unnest({_TOKENS.format("text")}) AS w FROM benchmark) GROUP BY 1 HAVING count(*) = 1)
        SELECT w AS word, doc_id, item_id FROM a JOIN b USING (w)""",
    "overlapping_intervals": """
        WITH i AS (SELECT l_suppkey AS g, CAST(epoch(l_shipdate) / 86400 AS BIGINT) AS s, CAST(epoch(l_shipdate) / 86400 AS BIGINT) + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
        r AS (SELECT *, max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i)
        SELECT g AS "group", count(*) AS n, count(*) FILTER (s < reach) AS overlapping FROM r GROUP BY 1""",
    "maximal_terms": """
        WITH t AS (SELECT DISTINCT term FROM (SELECT p_name AS term FROM part UNION ALL SELECT lower(r_name) FROM region UNION ALL VALUES ('small'), ('ring'), ('asia')))
        SELECT term FROM t WHERE NOT EXISTS (SELECT 1 FROM t AS o WHERE length(o.term) > length(t.term) AND contains(o.term, t.term))""",
    "restart_sessions": """
        SELECT user_id, 1 + count(*) FILTER (value <= before) AS sessions FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1""",
    "forward_fill": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked_in FROM conversations",
    "answered_turns": """
        SELECT conv_id, turn, CAST(answer AS INTEGER) AS answer_chars FROM (SELECT conv_id, turn, role, CASE WHEN lead(role) OVER w = 'assistant' THEN length(lead(text) OVER w) END AS answer
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""",
    "latest_events": "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank, event_id, event_type FROM events QUALIFY rank <= 2",
    "blocked_events": "SELECT event_id, coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS blocked FROM events",
    "event_windows": "SELECT date_trunc('hour', ts) AS starts, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """
        WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
        SELECT user_id, min(ts) AS starts, count(*) AS n FROM s GROUP BY user_id, k""",
    "property_path": """
        SELECT event_type, count(v) AS n, min(v) AS least, max(v) AS most, count(*) FILTER (v IS NULL) AS missing
        FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events) GROUP BY 1""",
    "in_effect": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_id FROM events",
    "occurrence_ids": """
        SELECT event_id, CAST(o AS INTEGER) AS ordinal, sha256(user_id || '|' || event_type || '|' || o) AS claim_id
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS o FROM events)""",
    "gate_results": """
        WITH k AS (SELECT TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
        g AS (SELECT 'k_known' AS gate, count(*) AS rows, count(*) FILTER (k >= 0) AS passed FROM k UNION ALL SELECT 'k_small', count(*), count(*) FILTER (k < 90) FROM k UNION ALL SELECT 'k_fifty', count(*), count(*) FILTER (k = 50) FROM k)
        SELECT *, rows > 0 AND rows = passed AS all_pass FROM g""",
    "rule_states": f"""
        WITH l AS (SELECT unnest({_LINES}) AS t FROM documents),
        m AS (SELECT regexp_matches(lower(email), '^noreply|(@|\\.)example\\.com$|\\.invalid$|(@|\\.)users\\.noreply\\.github\\.com$') AS exempt FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) AS email FROM documents))
        SELECT 'email' AS rule, CASE WHEN count(*) FILTER (NOT exempt) > 0 THEN 'hard' WHEN count(*) > 0 THEN 'warn' ELSE 'clean' END AS state FROM m
        UNION ALL SELECT 'denied_term', CASE WHEN count(*) > 0 THEN 'hard' ELSE 'clean' END FROM l WHERE regexp_matches(lower(t), 'password|license|token') UNION ALL SELECT 'user_path', CASE WHEN count(*) > 0 THEN 'hard' ELSE 'clean' END FROM ({_PATHS})""",
    "next_cells": "SELECT conv_id AS \"table\", turn AS col, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS \"right\" FROM conversations",
    "vocabulary_differences": f"""
        WITH a AS (SELECT DISTINCT unnest({_TOKENS.format("text")}) AS w FROM documents), b AS (SELECT DISTINCT unnest({_TOKENS.format("text")}) AS w FROM benchmark)
        SELECT 'both' AS side, count(*) AS words FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'left', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'right', count(*) FROM (FROM b EXCEPT FROM a)""",
    "first_qualifying": "SELECT l_orderkey AS key, min(l_linenumber) AS line, arg_min(q, l_linenumber) AS value FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) WHERE q >= 40 GROUP BY 1",
    "stale_users": """
        SELECT user_id, CAST(floor(epoch_us(m) / 1e6 - epoch_us(t) / 1e6) AS BIGINT) AS silent_s
        FROM (SELECT user_id, max(ts) AS t, (SELECT max(ts) FROM events) AS m FROM events GROUP BY 1) WHERE silent_s > 86400""",
    "canonical_json": "SELECT event_id, replace(props, ' ', '') AS canonical, sha256(replace(props, ' ', '')) AS digest FROM events",
    "paragraph_statistics": f"SELECT source, count(*) AS paragraphs, min(n) AS least, max(n) AS most, round(avg(n), 2) AS mean, CAST(median(n) AS DOUBLE) AS median FROM (SELECT source, CAST(length(trim(p, ' ')) AS INTEGER) AS n {_PARTED}) GROUP BY 1",
    "sentence_counts": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?…])[ \\n\\t]+', '\\1' || chr(1), 'g'), chr(1)) AS a, regexp_extract_all(t, '[^.!?]+[.!?]*') AS b, regexp_extract_all(t, '[^.!?\\n]+[.!?]?') AS c, regexp_split_to_array(t, '[.,。\\n]') AS d FROM t)
        SELECT doc_id, len(list_filter(a, lambda x: trim(x, ' ') <> '')) AS by_mark, len(list_filter(b, lambda x: trim(x, ' ') <> '')) AS by_match, len(list_filter(c, lambda x: trim(x, ' ') <> '')) AS by_line, len(list_filter(d, lambda x: trim(x, ' ') <> '')) AS by_clause FROM p""",
    "tag_masks": f"""
        WITH p AS (SELECT doc_id, text, regexp_split_to_array(text, '(?s)\\[\\[.*?\\]\\]') AS b, regexp_extract_all(text, '(?s)\\[\\[.*?\\]\\]') AS t FROM {PRIVATE_SQL} WHERE text IS NOT NULL),
        m AS (SELECT doc_id, text, array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || coalesce(regexp_replace(t[i], '[^\\n]', ' ', 'g'), '')), '') AS mask FROM p)
        SELECT doc_id, length(mask) = length(text) AS same_length, len(string_split(mask, chr(10))) = len(string_split(text, chr(10))) AS same_lines, sha256(regexp_replace(text, '(?s)\\[\\[.*?\\]\\]', ' ', 'g')) AS plain, sha256(mask) AS masked FROM m""",
    "bold_segments": f"""
        WITH p AS (SELECT doc_id, regexp_extract_all(text, '\\*\\*([^*\\n]+)\\*\\*', 1) AS s, regexp_split_to_array(text, '\\*\\*[^*\\n]+\\*\\*') AS b FROM {PRIVATE_SQL} WHERE text IS NOT NULL)
        SELECT doc_id, len(list_filter(b, lambda x: x <> '')) + len(s) AS segments, len(s) AS bold, CAST(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS bold_chars FROM p""",
    "heading_echoes": f"""
        WITH l AS (SELECT doc_id, unnest(x) AS text, CAST(unnest(range(1, len(x) + 1)) AS INTEGER) AS line FROM (SELECT doc_id, {_LINES} AS x FROM {PRIVATE_SQL} WHERE text IS NOT NULL)), i AS (SELECT *, trim(regexp_replace(lower(regexp_replace(text, '^#+ *', '')), '\\s+', ' ', 'g')) AS i FROM l WHERE starts_with(text, '#'))
        SELECT doc_id, line, text FROM i WHERE i IN ('guide', 'fill') OR starts_with(i, 'guide:') OR starts_with(i, 'fill:')""",
    "identity_numbers": f"""{_DIGITS}
        SELECT doc_id, line, kind, sha256(number) AS number FROM ({_IDENTITIES})""",
    "named_numbers": f"""
        WITH l AS (SELECT r, doc_id, unnest(x) AS text, CAST(unnest(range(1, len(x) + 1)) AS INTEGER) AS line FROM (SELECT row_number() OVER () AS r, doc_id, {_LINES} AS x FROM {PRIVATE_SQL} WHERE text IS NOT NULL)),
        {_NEAR} SELECT doc_id, line, start, text[start + 1 : least(stop, start + 60)] AS snippet FROM n""",
    "privacy_gate": f"""{_DIGITS},
        {_NEAR},
        m AS (SELECT DISTINCT doc_id, email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) AS email FROM {PRIVATE_SQL})),
        f AS (SELECT doc_id, CASE WHEN regexp_matches(lower(email), '^noreply|(@|\\.)example\\.com$|\\.invalid$|(@|\\.)users\\.noreply\\.github\\.com$') THEN 'WARN' ELSE 'HARD' END AS s FROM m
              UNION ALL SELECT doc_id, 'HARD' FROM ({_PATHS}) UNION ALL SELECT doc_id, 'HARD' FROM ({_IDENTITIES}) UNION ALL SELECT doc_id, 'WARN' FROM n
              UNION ALL SELECT doc_id, 'HARD' FROM l JOIN (VALUES ('password'), ('license'), ('token')) v(term) ON contains(lower(text), term))
        SELECT d.doc_id, count(*) FILTER (s = 'HARD') AS hard, count(*) FILTER (s = 'WARN') AS warn, count(*) FILTER (s = 'HARD') = 0 AS ok,
               CAST(CASE WHEN count(*) FILTER (s = 'HARD') > 0 THEN 3 WHEN count(*) FILTER (s = 'WARN') > 0 THEN 2 ELSE 0 END AS INTEGER) AS exit_code
        FROM (SELECT DISTINCT doc_id FROM {PRIVATE_SQL}) d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY 1""",
    "box_overlaps": """
        WITH k AS (SELECT l_suppkey AS page, l_partkey % 60 AS x0, CAST(trunc(l_extendedprice) AS BIGINT) % 60 AS y0, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2, 3), b AS (SELECT page, x0 * 100 + y0 AS id, x0, y0, x0 + 1 + q % 9 AS x1, y0 + 1 + q % 5 AS y1 FROM k),
        h AS (SELECT DISTINCT a.page, a.id FROM b AS a JOIN b ON a.page = b.page AND a.id <> b.id AND greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) >= 0.3::DOUBLE * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)))
        SELECT page, count(*) AS boxes, count(h.id) AS hit FROM b LEFT JOIN h USING (page, id) GROUP BY 1""",
    "missing_requirements": f"SELECT DISTINCT owner, item FROM (SELECT c_mktsegment AS owner, c_nationkey AS item FROM customer UNION ALL SELECT owner, item FROM {values(UNMET, 'owner, item')}) WHERE item NOT IN (SELECT s_nationkey FROM supplier)",
    "late_outputs": """SELECT l_orderkey AS key, count(*) FILTER (o_orderkey IS NULL OR epoch(l_shipdate) > epoch(o_orderdate) + 5184000) AS late FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING late > 0""",
    "first_codes": "SELECT p_partkey AS id, CASE " + " ".join(f"WHEN contains(lower(p_name || ' ' || p_type), '{k.lower()}') THEN '{c}'" for k, c in CODES) + " END AS code FROM part",
    "module_levels": f"""WITH RECURSIVE m AS {values(MODULES, 'module, requires')}, r AS (SELECT module, CAST(0 AS BIGINT) AS level FROM m UNION SELECT m.module, level + 1 FROM r JOIN m ON m.requires = r.module) SELECT module, max(level) AS level FROM r GROUP BY 1""",
    "apportioned": """WITH k AS (SELECT l_orderkey AS key, l_linenumber AS part, CAST(sum(l_quantity) AS BIGINT) AS ratio FROM lineitem GROUP BY 1, 2), u AS (SELECT *, floor(42520 * sum(ratio) OVER (PARTITION BY key ORDER BY part) / sum(ratio) OVER (PARTITION BY key)) AS upto FROM k)
        SELECT key, part, CAST(upto - coalesce(lag(upto) OVER (PARTITION BY key ORDER BY part), 0) AS BIGINT) AS width FROM u""",
    **claims_queries.ORACLE_SQL,
    **forms_queries.ORACLE_SQL,
    **workflow_queries.ORACLE_SQL,
    **documents_queries.ORACLE_SQL,
    **contents_queries.ORACLE_SQL,
    **evidence_queries.ORACLE_SQL,
    **spans_queries.oracle(_IDENTITIES, _DIGITS),
    **preflight_queries.ORACLE_SQL,
    **packs_queries.ORACLE_SQL,
    **trees_queries.ORACLE_SQL,
}
