"""Each registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from quarry.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got
    if name in ORACLE_SQL:
        r = tables.execute(ORACLE_SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(x[names.index(c)] for c in columns) for x in r.fetchall()), key=str)
