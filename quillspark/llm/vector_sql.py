"""DuckDB SQL of the two operators that move centroids, one pair of common table expressions for each round."""

from __future__ import annotations

from . import centroids, vector_codes

_FINITE = "len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"
_DISTANCE = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _integers(scale: int) -> str:
    return f"list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"


def _rounds(n: int) -> str:
    """a<i>: r, part, m (distance d and entry e of the nearest) of points p and codebooks c<i>; c<i+1>: the floored means. The last are a<n>, c<n>."""
    out = []
    for i in range(n + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT p.r, p.part, any_value(p.v) AS v, min(struct_pack(d := {_DISTANCE}, e := c.e)) AS m FROM p JOIN c{i} AS c ON p.part = c.part GROUP BY p.r, p.part)")
        if i < n:
            means = f"SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT part, e, i, sum(x) AS s, count(*) AS n FROM (SELECT part, m.e AS e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY ALL) GROUP BY part, e"
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(n.v, c.v) AS v FROM c{i} AS c LEFT JOIN ({means}) AS n ON n.part = c.part AND n.e = c.e)")
    return ",\n        ".join(out)


def clusters_sql() -> str:
    n = centroids.ROUNDS
    return f"""
        WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_integers(centroids.SCALE)} AS v FROM embeddings WHERE len(embedding) = {centroids.LENGTH} AND {_FINITE}),
        p AS (SELECT r, 0 AS part, v FROM k),
        c0 AS MATERIALIZED (SELECT 0 AS part, row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id), v) - 1 AS e, v FROM k QUALIFY e < {centroids.CLUSTERS}),
        {_rounds(n)},
        f AS (SELECT vec_id, m.e AS e, m.d AS d FROM a{n} JOIN k USING (r))
        SELECT vec_id, CAST(f.e AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY f.e) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM f JOIN c{n} AS c ON c.e = f.e"""


def codes_sql() -> str:
    n, parts = vector_codes.ROUNDS, vector_codes.PARTS
    return f"""
        WITH w AS (SELECT * FROM embeddings WHERE {_FINITE} AND len(embedding) > 0 AND len(embedding) % {parts} = 0),
        k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, {_integers(vector_codes.SCALE)} AS v FROM w WHERE len(embedding) = (SELECT len(embedding) FROM w GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)),
        p AS MATERIALIZED (SELECT r, vec_id, part, v[1 + part * len(v) // {parts} : (part + 1) * len(v) // {parts}] AS v FROM k, (SELECT unnest(range({parts})) AS part)),
        s AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM k QUALIFY e < {vector_codes.ENTRIES}),
        c0 AS MATERIALIZED (SELECT part, e, v FROM p JOIN s USING (r)),
        {_rounds(n)},
        f AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{n} GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) FROM c{n}) AS codebooks_sha256 FROM f JOIN k USING (r)"""
