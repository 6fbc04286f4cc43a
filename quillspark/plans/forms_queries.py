"""Queries on cells, seats, styles and settings, with the SQL that they equal. Lines of orders are the rows of forms; part of their cells is written differently in the blank form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import forms, text
from ..sources.tables import read_table
from .fixtures import ENVELOPES, FORBIDDEN, REPORTS_SQL, TRIALS, literal, reports, values
from .shared import dealt, scan_partitions

_TEXTS = ["max(l_returnflag)", "max(l_linestatus)", "CAST(CAST(max(l_quantity) AS BIGINT) AS {string})"]
#: What the document and the blank form have in a cell, and which cells they lack, for Spark and SQL alike.
_NOW, _WAS = "CASE WHEN (doc * 3 + col) % 5 = 0 THEN '' ELSE text END", "CASE WHEN (doc + row + col) % 4 = 0 THEN '' WHEN (doc + row + col) % 7 = 0 THEN concat(text, ' x') ELSE text END"
_KEPT, _BASE = "(doc + row) % 11 <> 0", "(doc + col) % 13 <> 0"


def _all_cells(spark, sf_dir) -> DataFrame:
    lines = dealt(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity"), "l_orderkey")
    rows = lines.groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("row"))
    wide = rows.agg(F.array(*[F.struct(F.lit(i).cast("long").alias("col"), F.expr(t.format(string="string")).alias("text")) for i, t in enumerate(_TEXTS, 1)]).alias("cells"))
    return wide.select("doc", F.lit(0).cast("long").alias("tab"), "row", F.explode("cells").alias("c")).select("doc", "tab", "row", "c.col", "c.text")


def _cells(spark, sf_dir) -> DataFrame:
    return _all_cells(spark, sf_dir).where(_KEPT).select("doc", "tab", "row", "col", F.expr(_NOW).alias("text"))


def _baseline(spark, sf_dir) -> DataFrame:
    return _all_cells(spark, sf_dir).where(_BASE).select("doc", "tab", "row", "col", F.expr(_WAS).alias("text"))


def _both(operator, *more):
    return lambda spark, sf_dir: operator(_cells(spark, sf_dir), _baseline(spark, sf_dir), *more)


def _one(operator, *more):
    return lambda spark, sf_dir: operator(_cells(spark, sf_dir), *more)


TERMS = ["fill in here", "name", "user name"]


def seat_states(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations").selectExpr("conv_id AS doc", "turn AS seat", "CASE WHEN turn % 4 = 0 THEN 'fill in here: user name' WHEN turn % 4 = 1 THEN concat('name ', role) WHEN turn % 4 = 2 THEN ' __ ' ELSE role END AS text")
    return forms.seat_states(rows, TERMS)


def form_states(spark, sf_dir):
    return forms.form_states(_cells(spark, sf_dir), _baseline(spark, sf_dir), F.col("text") == "50")


def _blocks(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 2).cast("long").alias("block"), F.col("l_linenumber").cast("long").alias("number"), F.col("l_returnflag").alias("label"))


def block_differences(spark, sf_dir):
    return forms.block_differences(_blocks(spark, sf_dir).where("(doc + number) % 6 <> 0"), _blocks(spark, sf_dir))


def best_grids(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS doc", "l_partkey % 40 AS grid", "concat(l_returnflag, CAST(l_quantity AS BIGINT)) AS label")
    return forms.best_grids(rows.where("(grid + length(label)) % 7 <> 0"), rows, partitions=scan_partitions(rows))


def unallowed_styles(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS kind", "CAST(l_quantity AS BIGINT) AS value", "l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS at", "l_linestatus AS text")
    return forms.unallowed_styles(rows.distinct(), read_table(spark, sf_dir, "part").selectExpr("CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'N' END AS kind", "CAST(p_size AS BIGINT) AS value"))


def style_differences(spark, sf_dir):
    rows = read_table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_brand AS font", "p_type AS face", "p_size AS size")
    other = rows.selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE font END AS font", "face", "CASE WHEN id % 5 = 0 THEN size + 1 ELSE size END AS size")
    return forms.differing_fields(other, rows, "id", ["font", "face", "size"])


def _elements(spark, sf_dir) -> DataFrame:
    return text.element_counts(read_table(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc"), F.col("element").alias("feature"), "n")


def inside_envelopes(spark, sf_dir):
    few = _elements(spark, sf_dir).where(F.col("feature").isin("p", "a", "li", "ul", "h1", "div"))
    return forms.inside_envelopes(few, spark.createDataFrame(ENVELOPES, "entry string, feature string, most long"))


KEYS = [("widget", True), ("cold widget", False), ("small", False), ("cold widget of steel", True), ("ring", True)]


def declared_blanks(spark, sf_dir):
    return forms.declared_blanks(read_table(spark, sf_dir, "part").select(F.col("p_name").alias("text")), spark.createDataFrame(KEYS, "key string, blank boolean"))


def unresolved_pointers(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").selectExpr("CASE event_id % 4 WHEN 0 THEN 'order' WHEN 1 THEN 'part' WHEN 2 THEN 'customer' ELSE 'nothing' END AS kind", "user_id * 7 AS id")
    ids = lambda table, key: read_table(spark, sf_dir, table).select(F.col(key).alias("id"))
    return forms.unresolved_pointers(events, {"order": ids("orders", "o_orderkey"), "part": ids("part", "p_partkey"), "customer": ids("customer", "c_custkey")})


def packet_faults(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc", "l_returnflag AS marker", "CAST(l_linenumber AS BIGINT) AS number", "l_quantity > 25 AS is_header")
    return forms.packet_faults(rows)


VOCABULARIES = {"de": ["der", "die", "und", "das", "sch"], "en": ["the", "and", "of", "that"], "es": ["de", "la", "que", "los"], "fr": ["le", "les", "et", "des"]}
FAMILIES = {"lists": ["ul", "li", "ol"], "text": ["p", "h1", "h2"], "tables": ["table", "tr", "td"]}


def vocabulary_votes(spark, sf_dir):
    return forms.vocabulary_votes(read_table(spark, sf_dir, "documents"), VOCABULARIES)


def section_orders(spark, sf_dir):
    heads = read_table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all(F.lower("html"), F.lit("<(h[1-6]|article|nav|footer|table)[ >]"), F.lit(1))).alias("position", "heading"))
    return forms.section_orders(heads.withColumnRenamed("page_id", "doc"))


def ragged_tables(spark, sf_dir):
    return forms.ragged_tables(text.keyed_lines(reports(spark, read_table(spark, sf_dir, "documents"))))


def gap_outliers(spark, sf_dir):
    return forms.gap_outliers(read_table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")))


def blanks_before(spark, sf_dir):
    return forms.blanks_before(text.keyed_lines(reports(spark, read_table(spark, sf_dir, "documents"))), F.col("text").rlike("^#|[!?]$"))


def residue(spark, sf_dir):
    return forms.residue(reports(spark, read_table(spark, sf_dir, "documents")), [x for (x,) in FORBIDDEN], '"[^"\n]*"')


def merged_settings(spark, sf_dir):
    packs = read_table(spark, sf_dir, "orders").selectExpr("o_custkey AS key", "o_orderstatus AS value", "o_orderpriority AS priority")
    return forms.merged_settings(packs, read_table(spark, sf_dir, "customer").where("c_acctbal < 0").selectExpr("c_custkey AS key", "'F' AS value"))


def ordered_union(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus").agg(F.min("l_partkey").alias("position"))
    return forms.ordered_union(rows.selectExpr("l_suppkey AS key", "l_linenumber AS list", "position", "concat(l_returnflag, l_linestatus) AS item"))


def certified_groups(spark, sf_dir):
    rows = read_table(spark, sf_dir, "part").selectExpr("concat(p_type, p_size % 5) AS features", "CASE WHEN p_partkey % 3 = 0 THEN 'holdout' ELSE 'train' END AS split", "p_size > 5 AS pass")
    return forms.certified_groups(rows.unionByName(spark.createDataFrame(TRIALS, "features string, split string, pass boolean")))


def version_ranges(spark, sf_dir):
    version = F.concat_ws(".", F.expr("CASE WHEN p_partkey % 50 = 0 THEN 'x' ELSE CAST(p_size % 4 AS string) END"), F.col("p_partkey") % 12, F.col("p_size") % 3)
    return read_table(spark, sf_dir, "part").select("p_partkey", forms.version_fits(version, [(">=", (1, 2, 0)), ("<", (3, 0, 0)), ("!=", (2, 0, 0))]).alias("fits"))


def page_sizes(spark, sf_dir):
    width, height = (F.lit(180.0) + F.col("p_size")), (F.lit(240.0) + F.col("p_partkey") % 120)
    units, kind = forms.page_geometry(width, height)
    return read_table(spark, sf_dir, "part").select("p_partkey", units.alias("units"), kind.alias("page"))


def colours(spark, sf_dir):
    brightness, kind = forms.colour_class(F.when(F.col("p_partkey") % 9 == 0, "red").otherwise(F.lpad(F.hex((F.col("p_partkey") * 7919 * 131) % 16777216), 6, "0")))
    return read_table(spark, sf_dir, "part").select("p_partkey", brightness.alias("brightness"), kind.alias("colour"))


QUERIES = {
    "cell_changes": _both(forms.cell_changes),
    "seats_changed": _both(forms.seats_changed),
    "mixed_rows": _one(forms.mixed_rows),
    "cell_neighbours": _one(forms.neighbours),
    "cell_kinds": _one(forms.cell_kinds),
    "seat_states": seat_states,
    "form_states": form_states,
    "geometry_changes": _both(forms.geometry_changes),
    "block_differences": block_differences,
    "best_grids": best_grids,
    "unallowed_styles": unallowed_styles,
    "style_differences": style_differences,
    "inside_envelopes": inside_envelopes,
    "declared_blanks": declared_blanks,
    "unresolved_pointers": unresolved_pointers,
    "packet_faults": packet_faults,
    "vocabulary_votes": vocabulary_votes,
    "rule_families": lambda spark, sf_dir: forms.rule_families(_elements(spark, sf_dir), FAMILIES),
    "section_orders": section_orders,
    "ragged_tables": ragged_tables,
    "gap_outliers": gap_outliers,
    "blanks_before": blanks_before,
    "residue": residue,
    "merged_settings": merged_settings,
    "ordered_union": ordered_union,
    "certified_groups": certified_groups,
    "version_ranges": version_ranges,
    "page_sizes": page_sizes,
    "colours": colours,
}

_CELLS = f"""k AS (SELECT l_orderkey AS doc, CAST(0 AS BIGINT) AS tab, CAST(l_linenumber AS BIGINT) AS row, {', '.join(f'{t.format(string="VARCHAR")} AS t{i}' for i, t in enumerate(_TEXTS, 1))} FROM lineitem GROUP BY 1, 2, 3),
    e AS ({' UNION ALL '.join(f'SELECT doc, tab, row, CAST({i} AS BIGINT) AS col, t{i} AS text FROM k' for i in (1, 2, 3))}),
    c AS (SELECT doc, tab, row, col, {_NOW} AS text, regexp_replace({_NOW}, '\\s', '', 'g') AS s FROM e WHERE {_KEPT}), b AS (SELECT doc, tab, row, col, regexp_replace({_WAS}, '\\s', '', 'g') AS s FROM e WHERE {_BASE}),
    d AS (SELECT * FROM (SELECT doc, tab, row, col, CASE WHEN c.s IS NULL THEN 'removed' WHEN c.s = b.s THEN NULL WHEN b.s = '' THEN 'filled' WHEN c.s = '' THEN 'emptied' ELSE 'changed' END AS change FROM b LEFT JOIN c USING (doc, tab, row, col)) WHERE change IS NOT NULL)"""
_FEATURES = "f AS (SELECT page_id AS doc, e AS feature, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) AS e FROM pages) GROUP BY ALL)"
_SPLIT = "regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')"
_LINES = f"l AS (SELECT doc_id, unnest(x) AS text, CAST(unnest(range(1, len(x) + 1)) AS INTEGER) AS line FROM (SELECT doc_id, {_SPLIT} AS x FROM {REPORTS_SQL} WHERE text IS NOT NULL))"
_BLOCKS = "k AS (SELECT l_orderkey AS doc, CAST(l_linenumber % 2 AS BIGINT) AS block, CAST(l_linenumber AS BIGINT) AS number, l_returnflag AS label FROM lineitem)"
_HITS = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(map(literal, own))}))) AS n_{v}" for v, own in VOCABULARIES.items())
_MOST = f"greatest({', '.join(f'n_{v}' for v in VOCABULARIES)})"
ORACLE_SQL = {
    "cell_changes": f"WITH {_CELLS} SELECT * FROM d",
    "seats_changed": f"WITH {_CELLS} SELECT doc, count(*) FILTER (NOT EXISTS (SELECT 1 FROM c WHERE c.doc = b.doc AND c.s = b.s)) AS changed FROM b GROUP BY 1",
    "mixed_rows": f"WITH {_CELLS} SELECT doc, tab, row, count(*) FILTER (s <> '') AS filled, count(*) FILTER (s = '') AS blank FROM c GROUP BY 1, 2, 3 HAVING count(*) FILTER (s <> '') > 0 AND count(*) FILTER (s = '') > 0",
    "cell_neighbours": f"WITH {_CELLS} SELECT doc, tab, row, col, lead(text) OVER (PARTITION BY doc, tab, row ORDER BY col) AS \"right\", lead(text) OVER (PARTITION BY doc, tab, col ORDER BY row) AS below FROM c",
    "cell_kinds": f"WITH {_CELLS}, n AS (SELECT s <> '' AS f, lag(s <> '') OVER (PARTITION BY doc, tab, row ORDER BY col) AS x, lag(s <> '') OVER (PARTITION BY doc, tab, col ORDER BY row) AS y FROM c) SELECT CASE WHEN f THEN 'label' WHEN coalesce(x, false) OR coalesce(y, false) THEN 'fill_target' ELSE 'spacer' END AS kind, count(*) AS cells FROM n GROUP BY 1",
    "seat_states": """
        WITH k AS (SELECT conv_id AS doc, turn AS seat, regexp_replace(CASE WHEN turn % 4 = 0 THEN 'fill in here: user name' WHEN turn % 4 = 1 THEN 'name ' || role WHEN turn % 4 = 2 THEN ' __ ' ELSE role END, '\\s', '', 'g') AS s FROM conversations),
        r AS (SELECT *, contains(s, 'fillinhere') OR contains(s, 'username') OR contains(s, 'name') AS held, regexp_replace(replace(replace(replace(s, 'fillinhere', ''), 'username', ''), 'name', ''), '[_.·○□]', '', 'g') <> '' AS more FROM k)
        SELECT doc, seat, CASE WHEN held AND more THEN 'half_filled' WHEN held THEN 'emptied' WHEN more THEN 'filled' ELSE 'blank_by_design' END AS state FROM r""",
    "form_states": f"WITH {_CELLS} SELECT doc, CASE WHEN doc NOT IN (SELECT doc FROM d WHERE change IN ('filled', 'changed')) THEN 'blank' WHEN bool_or(text = '50') THEN 'final' ELSE 'draft' END AS state FROM c GROUP BY 1",
    "geometry_changes": f"WITH {_CELLS} SELECT doc, count(*) FILTER (c.s IS NULL) AS lost, count(*) FILTER (b.s IS NULL) AS added FROM b FULL JOIN c USING (doc, tab, row, col) WHERE b.s IS NULL OR c.s IS NULL GROUP BY 1",
    "block_differences": f"""WITH {_BLOCKS}, n AS (SELECT * FROM k WHERE (doc + number) % 6 <> 0), a AS (SELECT doc, block, list(number ORDER BY number, label) AS x FROM k GROUP BY 1, 2), b AS (SELECT doc, block, list(number ORDER BY number, label) AS x FROM n GROUP BY 1, 2),
        m AS (SELECT doc, block, count(*) AS missing FROM (SELECT * FROM k EXCEPT SELECT * FROM n) GROUP BY 1, 2)
        SELECT doc, block, coalesce(missing, 0) AS missing, coalesce(a.x = b.x, false) AS same_order FROM a LEFT JOIN b USING (doc, block) LEFT JOIN m USING (doc, block) WHERE coalesce(missing, 0) > 0 OR NOT coalesce(a.x = b.x, false)""",
    "unallowed_styles": """
        WITH r AS (SELECT DISTINCT l_returnflag AS kind, CAST(l_quantity AS BIGINT) AS value, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS place, l_linestatus AS text FROM lineitem), a AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'N' END AS kind, CAST(p_size AS BIGINT) AS value FROM part),
        f AS (SELECT *, row_number() OVER (PARTITION BY kind, value ORDER BY place) AS k FROM r WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.kind = r.kind AND a.value = r.value))
        SELECT kind, value, count(*) AS uses, string_agg(CASE WHEN k <= 5 THEN CAST(place AS VARCHAR) END, ',' ORDER BY place) AS places, arg_min(text, place) AS sample FROM f GROUP BY 1, 2""",
    "style_differences": "SELECT p_partkey AS id, concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'font' END, CASE WHEN p_partkey % 5 = 0 THEN 'size' END) AS fields FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0",
    "inside_envelopes": f"""WITH {_FEATURES}, g AS (SELECT * FROM f WHERE feature IN ('p', 'a', 'li', 'ul', 'h1', 'div')), v AS {values(ENVELOPES, 'entry, feature, most')}, x AS (SELECT DISTINCT doc, entry FROM g, v),
        y AS (SELECT doc, entry, bool_and(EXISTS (SELECT 1 FROM v WHERE v.entry = x.entry AND v.feature = g.feature AND g.n <= v.most)) AS ok FROM x JOIN g USING (doc) GROUP BY 1, 2) SELECT doc, bool_or(ok) AS inside FROM y GROUP BY 1""",
    "declared_blanks": f"""WITH k(key, blank) AS (VALUES {', '.join(f"({literal(a)}, {b})" for a, b in KEYS)}), h AS (SELECT * FROM (SELECT DISTINCT p_name AS text FROM part) JOIN k ON contains(text, key) OR contains(key, text)), g AS (SELECT key FROM h GROUP BY 1 HAVING count(*) = 1),
        c AS (SELECT text, bool_or(blank) AS blank FROM h JOIN g USING (key) GROUP BY 1) SELECT text, CASE WHEN blank IS NULL THEN 'unfilled' WHEN blank THEN 'keep' ELSE 'consumed' END AS outcome FROM (SELECT DISTINCT p_name AS text FROM part) LEFT JOIN c USING (text)""",
    "unresolved_pointers": """WITH p AS (SELECT CASE event_id % 4 WHEN 0 THEN 'order' WHEN 1 THEN 'part' WHEN 2 THEN 'customer' ELSE 'nothing' END AS kind, user_id * 7 AS id FROM events),
        t AS (SELECT 'order' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT 'part', p_partkey FROM part UNION ALL SELECT 'customer', c_custkey FROM customer) SELECT kind, count(*) AS pointers FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.kind = p.kind AND t.id = p.id) GROUP BY 1""",
    "packet_faults": """WITH k AS (SELECT DISTINCT l_orderkey AS doc, l_returnflag AS marker, CAST(l_linenumber AS BIGINT) AS number, l_quantity > 25 AS head FROM lineitem)
        SELECT doc, marker, number FROM k WHERE NOT head AND EXISTS (SELECT 1 FROM k AS h WHERE h.head AND h.doc = k.doc AND h.marker = k.marker) AND NOT EXISTS (SELECT 1 FROM k AS h WHERE h.head AND h.doc = k.doc AND h.marker = k.marker AND h.number = k.number)""",
    "vocabulary_votes": f"""WITH w AS (SELECT doc_id, regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+(?:[-''][\\p{{L}}\\p{{N}}]+)*') AS w FROM documents), n AS (SELECT doc_id, {_HITS} FROM w)
        SELECT doc_id, CASE WHEN {_MOST} > 0 AND {' + '.join(f'CAST(n_{v} = {_MOST} AS INTEGER)' for v in VOCABULARIES)} = 1 THEN CASE {' '.join(f"WHEN n_{v} = {_MOST} THEN '{v}'" for v in VOCABULARIES)} END END AS version, {_MOST} AS hits FROM n""",
    "rule_families": f"""WITH {_FEATURES}, s AS (SELECT doc, {', '.join(f"coalesce(sum(n) FILTER (feature IN ({', '.join(map(literal, own))})), 0) AS {n}" for n, own in FAMILIES.items())} FROM f GROUP BY 1)
        SELECT doc, concat_ws(',', {', '.join(f"CASE WHEN {n} >= 3 THEN '{n}' END" for n in sorted(FAMILIES))}) AS families FROM s""",
    "section_orders": "WITH h AS (SELECT page_id, array_to_string(regexp_extract_all(lower(html), '<(h[1-6]|article|nav|footer|table)[ >]', 1), '>') AS o FROM pages) SELECT o AS \"order\", count(*) AS documents FROM h WHERE o <> '' GROUP BY 1",
    "ragged_tables": f"""WITH {_LINES}, b AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS t, len(string_split(rtrim(text, '| '), '|')) - 1 AS cells FROM l WHERE starts_with(text, '|')),
        f AS (SELECT *, first_value(cells) OVER (PARTITION BY doc_id, t ORDER BY line) AS expected FROM b) SELECT doc_id, line, cells, expected FROM f WHERE cells <> expected""",
    "gap_outliers": """WITH g AS (SELECT user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))) AS gap FROM events), p AS (SELECT * FROM g WHERE gap > 0), m AS (SELECT key, median(gap) AS median FROM p GROUP BY 1)
        SELECT key, median, count(*) AS gaps, count(*) FILTER (gap > 1.8::DOUBLE * median) AS outliers FROM p JOIN m USING (key) GROUP BY 1, 2""",
    "blanks_before": f"""WITH {_LINES}, k AS (SELECT *, coalesce(max(CASE WHEN trim(text, ' ') <> '' THEN line END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last FROM l)
        SELECT doc_id, line, CAST(line - last - 1 AS BIGINT) AS blanks FROM k WHERE regexp_matches(text, '^#|[!?]$')""",
    "merged_settings": """WITH p AS (SELECT o_custkey AS key, o_orderstatus AS value, o_orderpriority AS priority FROM orders), t AS (SELECT key, arg_max(value, (priority, value)) AS top, count(DISTINCT value) AS n FROM p GROUP BY 1), f AS (SELECT c_custkey AS key FROM customer WHERE c_acctbal < 0)
        SELECT t.key, CASE WHEN f.key IS NULL THEN top ELSE 'F' END AS value, n AS values, f.key IS NOT NULL AND top <> 'F' AS floored FROM t LEFT JOIN f ON f.key = t.key""",
    "ordered_union": """WITH k AS (SELECT l_suppkey AS key, l_linenumber AS list, l_returnflag || l_linestatus AS item, min(l_partkey) AS position FROM lineitem GROUP BY 1, 2, 3), f AS (SELECT key, item, min((list, position)) AS met FROM k GROUP BY 1, 2)
        SELECT key, string_agg(item, ',' ORDER BY met, item) AS items FROM f GROUP BY 1""",
    "certified_groups": f"""WITH k AS (SELECT p_type || p_size % 5 AS features, p_partkey % 3 = 0 AS holdout, p_size > 5 AS pass FROM part UNION ALL SELECT features, split = 'holdout', pass FROM {values(TRIALS, 'features, split, pass')})
        SELECT features, count(*) FILTER (NOT holdout) AS train, count(*) FILTER (holdout) AS holdout FROM k GROUP BY 1 HAVING bool_and(pass) AND count(*) FILTER (k.holdout) > 0 AND count(*) FILTER (NOT k.holdout) > 0""",
    "version_ranges": """WITH v AS (SELECT p_partkey, p_partkey % 50 = 0 AS bad, (p_size % 4, CAST(p_partkey % 12 AS INTEGER), p_size % 3) AS v FROM part) SELECT p_partkey, CASE WHEN NOT bad THEN v >= (1, 2, 0) AND v < (3, 0, 0) AND v <> (2, 0, 0) END AS fits FROM v""",
    "page_sizes": """WITH k AS (SELECT p_partkey, 180.0::DOUBLE + p_size AS w, 240.0::DOUBLE + p_partkey % 120 AS h FROM part), s(i, n, a, b) AS (VALUES (1, 'A4', 210.0::DOUBLE, 297.0::DOUBLE), (2, 'Letter', 215.9, 279.4), (3, 'Legal', 215.9, 355.6), (4, 'B5', 182.0, 257.0)),
        m AS (SELECT p_partkey, arg_min(n, i) AS n FROM k JOIN s ON (abs(w - a) <= 0.012::DOUBLE * greatest(w, a) AND abs(h - b) <= 0.012::DOUBLE * greatest(h, b)) OR (abs(w - b) <= 0.012::DOUBLE * greatest(w, b) AND abs(h - a) <= 0.012::DOUBLE * greatest(h, a)) GROUP BY 1)
        SELECT p_partkey, CAST(floor(w * 7200 / 25.4::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS units, coalesce(n, 'other') AS page FROM k LEFT JOIN m USING (p_partkey)""",
    "colours": """WITH k AS (SELECT p_partkey, p_partkey % 9 = 0 AS bad, (p_partkey * 7919 * 131) % 16777216 AS x FROM part), c AS (SELECT *, x // 65536 AS r, (x // 256) % 256 AS g, x % 256 AS b FROM k)
        SELECT p_partkey, CASE WHEN NOT bad THEN round((r + g + b) / 3.0::DOUBLE / 255, 6) END AS brightness, CASE WHEN bad THEN NULL WHEN r >= 180 AND g <= 90 AND b <= 90 THEN 'near_red' WHEN b > 120 AND r < 100 AND g < 100 THEN 'blue' ELSE 'other' END AS colour FROM c""",
}
