"""Queries on numbers, claims, citations and references over the documents and a few reports, with the SQL that they equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.units import QUANTITIES, UNITS
from ..operators import claims
from ..sources.tables import read_table
from .fixtures import CONSTANTS, REPORTS_SQL, SUMMARY, literal, reports, values
from .shared import spread


def _claims(spark, sf_dir, told=False):
    return claims.numeric_claims(reports(spark, spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))), told)


def binding_conflicts(spark, sf_dir):
    every = claims.bindings(reports(spark, read_table(spark, sf_dir, "documents")))
    return claims.binding_conflicts(every.where("doc_id = -2"), every.where("doc_id <> -2"))


def summary_support(spark, sf_dir):
    return claims.summary_support(spark.createDataFrame(SUMMARY, "subject string, unit string, value double"), _claims(spark, sf_dir))


def numeric_leaves(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select("event_id", F.explode(claims.numeric_leaves("props")).alias("x"))
    return rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


def backed_claims(spark, sf_dir):
    results = read_table(spark, sf_dir, "events").select(F.explode(claims.numeric_leaves("props")).alias("result"))
    return claims.backed_claims(_claims(spark, sf_dir), results, spark.createDataFrame(CONSTANTS, "value double, unit string"))


def resolved_sources(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    cited = pages.select(F.concat("url", F.lit("#cited")).alias("source")).unionByName(spark.createDataFrame([("doi:10.1000/A.b",), ("No source",), ("https://gone.example.org/x",)], "source string"))
    return claims.resolved_sources(cited, pages.select(F.col("url").alias("source")).unionByName(spark.createDataFrame([("https://doi.org/10.1000/a.b",)], "source string")))


def traced_claims(spark, sf_dir):
    orders, lines = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem")
    own = orders.selectExpr("o_orderkey AS id", "CAST(o_custkey AS DOUBLE) AS value", "concat('Order ', o_orderkey, '  of ', o_custkey) AS text")
    ledger = orders.where("o_orderstatus <> 'O'").selectExpr("CAST(o_custkey AS DOUBLE) AS value", "concat('it says order ', o_orderkey, ' of ', o_custkey, ' here') AS assertion")
    return claims.traced_claims(own, ledger.unionByName(lines.where("l_linenumber = 1").selectExpr("CAST(l_orderkey % 50 AS DOUBLE) AS value", "concat('order ', l_orderkey) AS assertion")))


def text_forms(spark, sf_dir):
    docs = reports(spark, read_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.sha2(claims.composed("text"), 256).alias("nfc_hash"))


def turn_fingerprints(spark, sf_dir):
    """The text of a conversation in order, composed and without white space, as a digest, and its turns by role."""
    rows = read_table(spark, sf_dir, "conversations")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "")
    each = rows.groupBy("conv_id").agg(text.alias("text"), F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("asked"))
    return each.select("conv_id", "turns", "asked", F.sha2(T.squeeze(claims.composed("text")), 256).alias("fingerprint"))


def _of_told(operator):
    """An operator that takes only claims with a subject."""
    return lambda spark, sf_dir: operator(_claims(spark, sf_dir, told=True))


def _of_reports(operator):
    return lambda spark, sf_dir: operator(reports(spark, read_table(spark, sf_dir, "documents")))


def title_matches(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    changed = pages.select("id", F.when(F.col("id") % 3 == 0, F.concat("title", F.lit("s"))).when(F.col("id") % 3 == 1, F.concat_ws(" ", F.lit("on"), "title")).otherwise(F.reverse("title")).alias("title"))
    return claims.title_matches(changed, pages)


def longest_runs(spark, sf_dir):
    return claims.longest_runs(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    "numeric_claims": _claims,
    "unit_mismatches": _of_told(claims.unit_mismatches),
    "impossible_dimensions": _of_told(claims.impossible_dimensions),
    "bindings": _of_reports(claims.bindings),
    "binding_conflicts": binding_conflicts,
    "summary_support": summary_support,
    "numeric_leaves": numeric_leaves,
    "backed_claims": backed_claims,
    "section_scopes": _of_reports(claims.section_scopes),
    "without_references": _of_reports(claims.without_references),
    "reference_entries": _of_reports(claims.reference_entries),
    "citation_markers": _of_reports(claims.citation_markers),
    "unlisted_citations": _of_reports(claims.unlisted_citations),
    "resolved_sources": resolved_sources,
    "traced_claims": traced_claims,
    "title_matches": title_matches,
    "longest_runs": longest_runs,
    "text_forms": text_forms,
    "turn_fingerprints": turn_fingerprints,
}

_SPLIT = "regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')"
_LINES = f"l AS (SELECT doc_id, unnest(x) AS text, CAST(unnest(range(1, len(x) + 1)) AS INTEGER) AS line FROM (SELECT doc_id, {_SPLIT} AS x FROM {REPORTS_SQL} WHERE text IS NOT NULL))"
_Q = lambda pattern: literal(pattern)
_WORDS = "regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+(?:[-''][\\p{{L}}\\p{{N}}]+)*')"
_CLAIMS = f"""{_LINES},
    u AS {values(UNITS, 'alias, unit, dimension, scale')},
    runs AS (SELECT doc_id, line, text, regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?|[^0-9]+') AS k FROM l WHERE regexp_matches(text, '[0-9]')),
    m AS (SELECT doc_id, line, text, k, list_filter(range(1, len(k) + 1), lambda i: regexp_matches(k[i], '^[0-9]')) AS p FROM runs),
    w AS (SELECT doc_id, line, text, CAST(o AS INTEGER) AS ord, CASE WHEN p[o] > 1 AND NOT regexp_matches(k[p[o] - 1], '^[0-9]') THEN k[p[o] - 1] ELSE '' END AS gap, k[p[o]] AS raw, regexp_extract(coalesce(k[p[o] + 1], ''), '^ ?([A-Za-zµ°%]*)', 1) AS alias,
             CASE WHEN o > 1 THEN regexp_extract(coalesce(k[p[o - 1] + 1], ''), '^ ?([A-Za-zµ°%]*)', 1) END AS prior FROM (SELECT *, unnest(range(1, len(p) + 1)) AS o FROM m)),
    e AS (SELECT doc_id, line, text, ord, CASE WHEN prior IN (SELECT alias FROM u) THEN regexp_replace(gap, '^ ?[A-Za-zµ°%]*', '') ELSE gap END AS before, raw, alias FROM w),
    f AS (SELECT e.*, TRY_CAST(replace(raw, ',', '') AS DOUBLE) AS value, unit, dimension, CAST(scale AS DOUBLE) AS scale FROM e LEFT JOIN u USING (alias) WHERE NOT regexp_matches(before, '[A-Za-z_.]$')),
    g AS (SELECT *, (NOT contains(raw, '.') AND unit IS NULL AND value BETWEEN 1800 AND 2199) OR regexp_matches(text, {_Q(claims.HEADING)}) OR (ord = 1 AND regexp_matches(text, '^ *[0-9]+[.)] '))
            OR regexp_matches(regexp_extract(before, '([^ ]+) *$', 1), {_Q(claims.REFERENCE)}) AS ignored FROM f WHERE value IS NOT NULL),
    c AS (SELECT doc_id, line, ord, raw, value, unit, dimension, value * scale AS canonical,
            regexp_replace(nullif(lower(regexp_replace(regexp_extract(regexp_extract(before, '([^;,.!?。]*)$', 1), {_Q(claims.SUBJECT)}, 1), '(?i)^(?:the|an|a|and) +', '')), ''), '^(?:the|an|a) +', '') AS subject, ignored,
            NOT ignored AND (unit IS NOT NULL OR (contains(raw, '.') AND length(regexp_replace(regexp_replace(raw, '[.,]', '', 'g'), '^0+', '')) >= 2)) AS candidate FROM g)"""
_BINDINGS = f"""{_LINES},
    b AS (SELECT doc_id, line, lower(regexp_extract(text, {_Q(claims.BINDING)}, 1)) AS name, TRY_CAST(replace(regexp_extract(text, {_Q(claims.BINDING)}, 2), ',', '') AS DOUBLE) AS value, regexp_extract(text, {_Q(claims.BINDING)}, 3) AS unit
          FROM l WHERE regexp_matches(text, {_Q(claims.BINDING)}))"""
_SECTIONS = f"""{_LINES},
    s AS (SELECT doc_id, line, text, last_value(CASE WHEN regexp_matches(text, {_Q(claims.HEADING)}) THEN line END IGNORE NULLS) OVER w AS heading,
            coalesce(last_value(CASE WHEN regexp_matches(text, {_Q(claims.HEADING)}) THEN regexp_matches(text, {_Q(claims.REFERENCE_HEADING)}) END IGNORE NULLS) OVER w, false) AS reference
          FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_URL = "CASE WHEN lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) IN ('http', 'https') AND regexp_extract({0}, '://([^/?#]*)', 1) <> '' THEN lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract({0}, '://([^/?#]*)', 1)) || regexp_extract({0}, '://[^/?#]*([^#]*)', 1) END"
_ENTRIES = f"""{_SECTIONS},
    r AS (SELECT * FROM (SELECT *, min(heading) OVER (PARTITION BY doc_id) AS first FROM s WHERE reference) WHERE heading = first AND line > heading AND trim(text, ' ') <> ''),
    n AS (SELECT doc_id, line, trim(text, ' ') AS t, sum(CASE WHEN regexp_matches(text, '^ +') OR regexp_matches(text, '(?i)^(?:doi:|https?://|isbn )\\S+ *$') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS entry FROM r),
    x AS (SELECT doc_id, CAST(entry AS BIGINT) AS entry, string_agg(t, ' ' ORDER BY line) AS x FROM n GROUP BY 1, 2),
    y AS (SELECT *, nullif(regexp_extract(x, '^([^,.(]+),', 1), '') AS author, TRY_CAST(regexp_extract(x, '\\(([0-9]{{4}})[a-z]?\\)', 1) AS INTEGER) AS year, nullif(regexp_extract(x, '\\([0-9]{{4}}[a-z]?\\)\\. *([^.]+)\\.', 1), '') AS title,
            lower(nullif(regexp_extract(x, '(10\\.[0-9]{{4,9}}/[^ ]+)', 1), '')) AS doi, regexp_replace(regexp_extract(x, '(?i)isbn:? *([0-9][0-9 -]{{8,16}}[0-9Xx])', 1), '[ -]', '', 'g') AS i, nullif(regexp_extract(x, '(https?://[^ ]+)', 1), '') AS u FROM x),
    z AS (SELECT doc_id, entry, author, year, title, doi, regexp_replace(doi, '[^a-z0-9.-]', '_', 'g') AS doi_slug,
            CASE WHEN (length(i) = 10 AND list_sum(list_transform(range(1, 11), lambda k: (11 - k) * CASE WHEN upper(i[k]) = 'X' THEN 10 ELSE coalesce(TRY_CAST(i[k] AS INTEGER), 0) END)) % 11 = 0)
                   OR (length(i) = 13 AND list_sum(list_transform(range(1, 14), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE 3 END) * coalesce(TRY_CAST(i[k] AS INTEGER), 0))) % 10 = 0) THEN i END AS isbn,
            {_URL.format("u")} AS url, coalesce(year > 2026, false) AS future FROM y)"""
_CLOSE = "abs({0} - {1}) <= {2}::DOUBLE * greatest(abs({0}), abs({1}))"
_EXPECTED = "CASE " + " ".join(f"WHEN regexp_matches(subject, '(?:^| ){w}$') THEN '{d}'" for w, d in QUANTITIES) + " END"

ORACLE_SQL = {
    "numeric_claims": f"WITH {_CLAIMS} SELECT * FROM c",
    "unit_mismatches": f"""WITH {_CLAIMS}, k AS (SELECT * FROM c WHERE candidate AND subject IS NOT NULL AND dimension IS NOT NULL)
        SELECT a.doc_id, a.subject, a.line, b.line AS other_line, a.dimension, b.dimension AS other FROM k AS a JOIN k AS b ON a.doc_id = b.doc_id AND a.subject = b.subject AND (a.line, a.ord) < (b.line, b.ord) AND a.dimension <> b.dimension AND {_CLOSE.format('a.value', 'b.value', 0.01)}""",
    "impossible_dimensions": f"WITH {_CLAIMS} SELECT doc_id, line, subject, dimension, expected FROM (SELECT *, {_EXPECTED} AS expected FROM c WHERE candidate AND dimension IS NOT NULL) WHERE expected <> dimension",
    "bindings": f"WITH {_BINDINGS} SELECT * FROM b WHERE value IS NOT NULL",
    "binding_conflicts": f"""WITH {_BINDINGS}, p AS (SELECT a.name, a.unit, a.value AS now, b.value AS before, abs(a.value - b.value) / greatest(abs(a.value), abs(b.value)) AS d FROM b AS a JOIN b ON a.name = b.name AND a.unit = b.unit WHERE a.doc_id = -2 AND b.doc_id <> -2)
        SELECT name, unit, now, before, round(d, 6) AS difference FROM p WHERE d > 0.01 QUALIFY row_number() OVER (PARTITION BY name ORDER BY d DESC, now DESC, before DESC) = 1""",
    "summary_support": f"""WITH {_CLAIMS}, s AS (SELECT subject, unit, CAST(value AS DOUBLE) AS value FROM {values(SUMMARY, 'subject, unit, value')}), k AS (SELECT * FROM c WHERE candidate AND unit IS NOT NULL)
        SELECT subject, unit, value, CASE
            WHEN subject IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.unit = s.unit AND {_CLOSE.format('k.canonical', 's.value', 0.01)}) THEN 'supported' ELSE 'missing' END
            WHEN NOT EXISTS (SELECT 1 FROM k WHERE k.unit = s.unit AND k.subject = s.subject) THEN 'missing'
            WHEN (SELECT NOT ({_CLOSE.format('min(canonical)', 'max(canonical)', 0.01)}) FROM k WHERE k.unit = s.unit AND k.subject = s.subject) THEN 'ambiguous'
            WHEN EXISTS (SELECT 1 FROM k WHERE k.unit = s.unit AND k.subject = s.subject AND {_CLOSE.format('k.canonical', 's.value', 0.01)}) THEN 'supported' ELSE 'conflict' END AS verdict FROM s""",
    "numeric_leaves": "SELECT event_id, count(*) AS n, sum(CAST(atom AS DOUBLE)) AS total FROM events, json_tree(props) AS t WHERE t.type IN ('BIGINT', 'UBIGINT', 'DOUBLE') GROUP BY 1",
    "backed_claims": f"""WITH {_CLAIMS}, r AS (SELECT DISTINCT CAST(atom AS DOUBLE) AS result FROM events, json_tree(props) AS t WHERE t.type IN ('BIGINT', 'UBIGINT', 'DOUBLE')), k AS {values(CONSTANTS, 'value, unit')}
        SELECT doc_id, line, ord, value, CASE WHEN EXISTS (SELECT 1 FROM r WHERE result > 0 AND c.value > 0 AND {_CLOSE.format('c.value', 'result', 0.001)}) THEN 'result'
               WHEN EXISTS (SELECT 1 FROM k WHERE k.value = c.value AND (k.unit IS NULL OR k.unit = c.unit)) THEN 'constant' ELSE 'nothing' END AS backed_by FROM c WHERE candidate""",
    "section_scopes": f"""WITH {_LINES}, k AS (SELECT *, regexp_matches(text, {_Q(claims.HEADING)}) AS head, CASE WHEN regexp_matches(lower(text), 'summary|abstract') THEN 'summary' WHEN regexp_matches(lower(text), 'method') THEN 'method' WHEN regexp_matches(lower(text), 'result') THEN 'results' WHEN regexp_matches(lower(text), 'reference|참고문헌') THEN 'references' ELSE 'body' END AS kind FROM l),
        s AS (SELECT doc_id, head, text, coalesce(last_value(CASE WHEN head THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'body') AS scope FROM k)
        SELECT doc_id, scope, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM s WHERE NOT head GROUP BY 1, 2""",
    "without_references": f"WITH {_SECTIONS} SELECT doc_id, count(*) AS lines, count(*) FILTER (reference) AS blanked, sha256(string_agg(CASE WHEN reference THEN '' ELSE text END, chr(10) ORDER BY line)) AS body_hash FROM s GROUP BY 1",
    "reference_entries": f"WITH {_ENTRIES} SELECT * FROM z",
    "unlisted_citations": f"""WITH {_ENTRIES}, c AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Z][a-z]+) \\(([0-9]{{4}})[a-z]?\\)', 1)) AS surname, CAST(unnest(regexp_extract_all(text, '([A-Z][a-z]+) \\(([0-9]{{4}})[a-z]?\\)', 2)) AS INTEGER) AS year FROM s WHERE NOT reference)
        SELECT doc_id, surname, year, count(*) AS uses FROM c WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.doc_id = c.doc_id AND z.author = c.surname) GROUP BY 1, 2, 3""",
    "resolved_sources": f"""WITH c AS (SELECT DISTINCT source FROM (SELECT url || '#cited' AS source FROM pages UNION ALL VALUES ('doi:10.1000/A.b'), ('No source'), ('https://gone.example.org/x'))), a AS (SELECT url AS source FROM pages UNION ALL VALUES ('https://doi.org/10.1000/a.b')),
        n AS (SELECT source, side, unnest(['id:' || lower(trim(source)), 'doi:' || nullif(regexp_extract(lower(trim(source)), '(10\\.[0-9]{{4,9}}/[^ ]+)', 1), ''), 'url:' || {_URL.format("regexp_extract(source, '(https?://[^ ]+)', 1)")}]) AS name FROM (SELECT source, 1 AS side FROM c UNION ALL SELECT source, 2 FROM a))
        SELECT source, bool_or(EXISTS (SELECT 1 FROM n AS o WHERE o.side = 2 AND o.name = n.name)) AS resolved FROM n WHERE side = 1 AND name IS NOT NULL GROUP BY 1""",
    "traced_claims": """WITH e AS (SELECT CAST(o_custkey AS DOUBLE) AS value, 'it says order ' || o_orderkey || ' of ' || o_custkey || ' here' AS assertion FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT CAST(l_orderkey % 50 AS DOUBLE), 'order ' || l_orderkey FROM lineitem WHERE l_linenumber = 1)
        SELECT o_orderkey AS id, EXISTS (SELECT 1 FROM e WHERE value = o_custkey AND (contains(assertion, 'order ' || o_orderkey || ' of ' || o_custkey) OR contains('order ' || o_orderkey || ' of ' || o_custkey, assertion))) AS traced FROM orders""",
    "longest_runs": f"""WITH a AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents)), b AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS j FROM (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark)),
        m AS (SELECT DISTINCT doc_id, item_id, i, i - j AS d FROM (SELECT doc_id, i, array_to_string(w[i:i+11], ' ') AS g FROM a) JOIN (SELECT item_id, j, array_to_string(w[j:j+11], ' ') AS g FROM b) USING (g)),
        k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY i) AS island FROM m), n AS (SELECT doc_id, item_id, count(*) AS n FROM k GROUP BY doc_id, item_id, d, island)
        SELECT doc_id, item_id, max(n) + 11 AS run FROM n GROUP BY 1, 2""",
    "text_forms": f"SELECT doc_id, sha256(nfc_normalize(text)) AS nfc_hash FROM {REPORTS_SQL}",
    "turn_fingerprints": """SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, sha256(regexp_replace(nfc_normalize(string_agg(text, '' ORDER BY turn, text)), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', '', 'g')) AS fingerprint FROM conversations GROUP BY 1""",
}
