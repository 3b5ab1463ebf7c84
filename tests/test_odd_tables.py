"""Registered queries against their SQL on small tables with rows that the given ones lack."""

from datetime import datetime

import duckdb

from dossier.plans import catalog

DAY = datetime(1997, 3, 1)


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over these tables, each (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    cursor = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    got = catalog.QUERIES[name](spark, str(folder)).select(*columns).collect()
    return sorted(map(repr, map(tuple, got))), sorted(map(repr, cursor.fetchall()))


def test_a_rule_that_is_referred_to_twice_is_listed_once(spark, tmp_path):
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    orders = [(k, c, "P", 1.0, DAY, "2-HIGH") for k, c in [(5, 1), (11, 2), (17, 3), (23, 4), (1, 1), (0, 1)]]
    got, expected = against_sql(spark, tmp_path, "verdicts_normalised", orders=(orders, schema))
    assert got == expected


def test_merged_intervals_do_not_depend_on_ties(spark, tmp_path):
    """The SQL numbers groups in a second window, where rows tied on (a, b) may come in another order than in the first; without ties it says the same."""
    rows = [(k, p) for k in (0, 1, -7, 100) for p in (5, 5, 5, 25, 25, 46, 46, 46, -30, -30, 900)] * 3
    single = sorted({(0 if k == 100 else k, p) for k, p in rows})
    got, _ = against_sql(spark, tmp_path / "tied", "interval_merge", lineitem=(rows, "l_orderkey long, l_partkey long"))
    plain, expected = against_sql(spark, tmp_path / "single", "interval_merge", lineitem=(single, "l_orderkey long, l_partkey long"))
    assert got == plain == expected
