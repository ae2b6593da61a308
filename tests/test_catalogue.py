"""Each query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from docloom import catalogue, catalogue_packages, catalogue_rules, catalogue_updates  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(float(r[i]), 6) if isinstance(r[i], float) else r[i] for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    found = got.collect()
    if name not in catalogue.SQL:
        assert found
        return
    want = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in found]) == rows(columns, want.fetchall())
