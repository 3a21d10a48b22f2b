"""The registered queries that have SQL give its rows, on the smallest tables."""

import duckdb
import pytest

from wegloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(map(str, r)) for r in got.select(*want.columns).collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())
