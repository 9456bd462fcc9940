"""Every query that has SQL gives the SQL's rows."""

import duckdb
import pytest

from dossier.plans import archive, network, queries, records

DIR = "/root/testdata/sf0.001"
QUERIES = queries.queries() | archive.queries(records, network)
SQL = queries.oracle_sql() | archive.oracle_sql(records, network)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{DIR}/{t}.parquet'")
    found = con.execute(SQL[name])
    names, expected = [x[0] for x in found.description], found.fetchall()
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    got = sorted(str(tuple(r)) for r in got.select(names).collect())
    assert got == sorted(map(str, expected))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() >= 0
