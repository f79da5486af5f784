"""Queries with SQL: the same rows as the SQL gives, with the same types of numbers."""

import os

import duckdb
import pytest

from pagelens.llm.registry import oracle_sql, queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    got = queries()[name](spark, DIR)
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    want = con.sql(oracle_sql()[name])
    order = sorted(want.columns)
    rows = sorted((tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()), key=repr)  # nulls have no order
    assert sorted(got.columns) == order
    assert sorted((tuple(r) for r in got.select(*order).collect()), key=repr) == rows
