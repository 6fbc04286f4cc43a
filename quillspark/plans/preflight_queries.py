"""The preflight queries, and the SQL that they equal: by lines as rows, where the operator works on arrays."""

from __future__ import annotations

from ..operators import preflight
from ..sources.tables import read_table
from .fixtures import DRAFTS_SQL, drafts


def preflight_findings(spark, sf_dir):
    return preflight.findings(drafts(spark, read_table(spark, sf_dir, "documents")))


def submission_preflight(spark, sf_dir):
    return preflight.verdicts(drafts(spark, read_table(spark, sf_dir, "documents")))


QUERIES = {"preflight_findings": preflight_findings, "submission_preflight": submission_preflight}

_LINES = "regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')"
_BINDING = "^ *([A-Za-z][A-Za-z _]*?) *= *(-?[0-9]+(?:\\.[0-9]+)?) *([A-Za-z%]*) *$"
_CLOSE = "abs({0} - {1}) <= 0.001::DOUBLE * greatest(abs({0}), abs({1}))"
_FOUND = f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM {DRAFTS_SQL}),
        l AS (SELECT r, doc_id, unnest(x) AS t, CAST(unnest(range(1, len(x) + 1)) AS INTEGER) AS line FROM (SELECT r, doc_id, {_LINES} AS x FROM d WHERE text IS NOT NULL)),
        h AS (SELECT *, last_value(CASE WHEN regexp_matches(t, '^#{{1,6}} ') THEN CASE WHEN regexp_matches(lower(t), 'reference|bibliography|참고문헌') THEN 'references' WHEN regexp_matches(lower(t), 'summary|abstract') THEN 'summary' ELSE 'body' END END IGNORE NULLS) OVER (PARTITION BY r ORDER BY line) AS own FROM l),
        s AS (SELECT r, doc_id, line, t, coalesce(own, 'body') AS kind FROM h WHERE trim(t, ' ') <> '' AND NOT regexp_matches(t, '^#{{1,6}} ')),
        body AS (SELECT * FROM s WHERE kind = 'body'), refs AS (SELECT * FROM s WHERE kind = 'references'),
        listed AS (SELECT r, count(*) FILTER (kind = 'references' AND NOT starts_with(t, ' ')) AS entries FROM s WHERE r IN (SELECT r FROM h WHERE own = 'references') GROUP BY r),
        b AS (SELECT r, doc_id, line, lower(regexp_extract(t, '{_BINDING}', 1)) AS name, CAST(regexp_extract(t, '{_BINDING}', 2) AS DOUBLE) AS value, regexp_extract(t, '{_BINDING}', 3) AS unit FROM body WHERE regexp_matches(t, '{_BINDING}')),
        n AS (SELECT *, CAST(raw AS DOUBLE) AS value FROM (SELECT r, doc_id, kind, line, unnest(regexp_extract_all(t, '[0-9]+\\.[0-9]+')) AS raw FROM s WHERE kind = 'summary' OR kind = 'body' AND NOT regexp_matches(t, '{_BINDING}'))),
        g AS (SELECT r, doc_id, line, regexp_extract(tag, 'file="([^"]*)"', 1) AS file, contains(tag, 'caption="') AS told, row_number() OVER (PARTITION BY r, regexp_extract(tag, 'file="([^"]*)"', 1) ORDER BY line, i) AS nth
              FROM (SELECT r, doc_id, line, unnest(a) AS tag, unnest(range(len(a))) AS i FROM (SELECT *, regexp_extract_all(t, '\\[\\[FIG [^\\]]*\\]\\]') AS a FROM body))),
        u AS (SELECT *, row_number() OVER (PARTITION BY r, url ORDER BY line) AS nth FROM (SELECT r, doc_id, line, regexp_extract(t, 'https?://[^ )]+') AS url FROM refs) WHERE url <> ''),
        f AS (SELECT r, doc_id, 'content' AS checker, 'HARD' AS severity, line, lower(unnest(regexp_extract_all(t, '(?i)\\b(?:todo|tbd|fixme)\\b|fill in here'))) AS detail FROM s WHERE kind <> 'references'
            UNION ALL SELECT r, doc_id, 'content', 'WARN', line, '[[' FROM s WHERE kind <> 'references' AND contains(t, '[[') AND NOT contains(t, ']]')
            UNION ALL SELECT r, doc_id, 'style', 'WARN', line, p FROM body JOIN (VALUES {', '.join(f"('{p}')" for p in preflight.PHRASES)}) v(p) ON contains(lower(t), p)
            UNION ALL SELECT r, doc_id, 'numbers', 'WARN', line, raw FROM n WHERE kind = 'body' AND r IN (SELECT r FROM b) AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = n.r AND {_CLOSE.format("b.value", "n.value")})
            UNION ALL SELECT r, doc_id, 'refs', 'HARD', line, c FROM (SELECT r, doc_id, line, unnest(regexp_extract_all(t, '\\[([0-9]{{1,3}})\\]', 1)) AS c FROM body) JOIN (SELECT DISTINCT h.r, coalesce(entries, 0) AS entries FROM h LEFT JOIN listed USING (r) WHERE own = 'references') USING (r) WHERE CAST(c AS INTEGER) NOT BETWEEN 1 AND entries
            UNION ALL SELECT r, doc_id, 'figures', 'WARN', line, file FROM g WHERE NOT told UNION ALL SELECT r, doc_id, 'figures', 'HARD', line, file FROM g WHERE nth > 1
            UNION ALL SELECT r, doc_id, 'sources', 'HARD', line, y FROM (SELECT r, doc_id, line, unnest(regexp_extract_all(t, '\\(((?:19|20)[0-9]{{2}})\\)', 1)) AS y FROM refs) WHERE CAST(y AS INTEGER) > 2026
            UNION ALL SELECT r, doc_id, 'sources', 'WARN', line, url FROM u WHERE nth > 1
            UNION ALL SELECT r, doc_id, 'units', 'WARN', min(line), name FROM b GROUP BY r, doc_id, name HAVING count(DISTINCT unit) > 1
            UNION ALL SELECT r, doc_id, 'summary', 'HARD', line, raw FROM n WHERE kind = 'summary' AND r IN (SELECT r FROM body) AND NOT EXISTS (SELECT 1 FROM (SELECT r, value FROM n AS m WHERE kind = 'body' UNION ALL SELECT r, value FROM b) AS k WHERE k.r = n.r AND {_CLOSE.format("k.value", "n.value")})
            UNION ALL SELECT r, doc_id, 'claims', 'HARD', line, m FROM (SELECT r, doc_id, line, unnest(regexp_extract_all(t, '\\[@([a-z0-9]+)\\]', 1)) AS m FROM body WHERE r IN (SELECT r FROM h WHERE own = 'references')) AS c WHERE NOT EXISTS (SELECT 1 FROM refs WHERE refs.r = c.r AND contains(refs.t, '@' || m)))"""

ORACLE_SQL = {
    "preflight_findings": f"{_FOUND} SELECT doc_id, checker, severity, line, detail FROM f",
    "submission_preflight": f"""{_FOUND}
        SELECT d.doc_id, count(*) FILTER (severity = 'HARD') AS hard, count(*) FILTER (severity = 'WARN') AS warn, coalesce(string_agg(DISTINCT checker, ',' ORDER BY checker), '') AS checkers,
               CASE WHEN count(*) FILTER (severity = 'HARD') > 0 THEN 'fail' ELSE 'pass' END AS verdict, CAST(CASE WHEN count(*) FILTER (severity = 'HARD') > 0 THEN 3 ELSE 0 END AS INTEGER) AS exit_code
        FROM d LEFT JOIN f USING (r) GROUP BY d.r, d.doc_id""",
}
