"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from dossier.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    expected = [tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in order) for r in cursor.fetchall()]
    rows = [tuple(plain(r[c]) for c in order) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))
