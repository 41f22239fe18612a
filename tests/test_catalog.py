"""Every registered query: its rows at the smallest size, against DuckDB where there is SQL."""

import math
import os

import duckdb
import pytest

from manyfold.catalog import analytics, formats, keyed, reports, sequences, similarity

MODULES = (keyed, sequences, analytics, similarity, reports, formats)
SF = "/root/testdata/sf0.001"
QUERIES = {n: q for m in MODULES for n, q in m.catalog.queries.items()}
SQL = {n: q for m in MODULES for n, q in m.catalog.sql.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    told = duck.execute(SQL[name])
    names = [x[0] for x in told.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in places) for r in told.fetchall())


@pytest.mark.parametrize("name", ["filter_shuffle", "taxonomy", "multihitsearch", "search_profile", "search_targetprofile", "filtera3m", "align2clust", "cluster_reassigned", "pickconsensusrep", "fwbw", "easy_taxonomy", "easy_proteomesearch"])
def test_runs(spark, name):
    found = QUERIES[name](spark, SF)
    rows = found.collect()
    assert rows and len(set(found.columns)) == len(rows[0])


def test_names_are_unique():
    parts = [m.catalog.queries for m in MODULES]
    assert sum(map(len, parts)) == len(QUERIES)
