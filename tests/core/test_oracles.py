"""Each query against its SQL on the same tables, in any order of rows."""

import os

import duckdb
import pytest

from pagelens.queries import inline_queries, inline_sql, oracle_sql, queries

DIR = "/root/testdata/sf0.001"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql() | inline_sql()))
def test_query_equals_sql(spark, name):
    got = (queries() | inline_queries())[name](spark, DIR)
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    want = con.sql((oracle_sql() | inline_sql())[name])
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())
