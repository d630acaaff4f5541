"""Every mesh query against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from trilattice.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    key = lambda r: tuple((x is None, round(x, 4) if isinstance(x, float) else x) for x in r)
    return sorted((tuple(r) for r in rows), key=key)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    found = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(found.columns)
    want = plain(found.select(*(f'"{c}"' for c in got.columns)).fetchall())
    rows = plain(got.collect())
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=2e-6) for x, y in zip(a, b)), (a, b)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    theirs = dict(zip(found.columns, map(str, found.types)))
    assert {c: kinds[t] for c, t in got.dtypes} == theirs
