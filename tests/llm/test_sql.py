"""The operators that SQL can express, against it."""

import os

import duckdb
import pytest

from quarterlens.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, sf, name):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    got, want = QUERIES[name](spark, sf), c.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = ", ".join(sorted(want.columns))
    rows = sorted(tuple(r) for r in got.select(*sorted(got.columns)).collect())
    assert rows == sorted(c.sql(f"select {columns} from ({SQL[name]})").fetchall())
