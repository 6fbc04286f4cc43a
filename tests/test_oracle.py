"""Every registered query against its SQL."""

import duckdb
import pytest

from quillspark.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values):
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


#: Held against brute force in test_reports.py and test_contents.py.
NO_SQL = {"citation_markers", "content_audit", "title_matches", "title_coverage", "best_grids", "residue"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) | NO_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == names
    want = [tuple(r[columns.index(c)] for c in names) for r in got.fetchall()]
    assert rows(map(tuple, df.select(*names).collect())) == rows(want)
