"""Registered queries that SQL can express, against DuckDB at the smallest size."""

import os

import duckdb
import pytest

from manyfold.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    found = queries.queries()[name](spark, SF)
    told = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in told.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(str(tuple(r[c] for c in names)) for r in found.collect()) == sorted(map(str, told.fetchall()))


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
