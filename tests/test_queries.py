"""Each query against its SQL in DuckDB, and the shape of those without SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from pebblegraph import queries

SQL = queries.oracle_sql()
REST = sorted(queries.queries().keys() - SQL.keys())
#: Sampled, or iterated kernels: an empty result would be a fault.
SOME_ROWS = [n for n in REST if n not in ("precoarsen_levels",)]


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(tables).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return round(float(v), 5) + 0.0


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, tables, duck, name):
    got = queries.queries()[name](spark, tables)
    found = duck.execute(SQL[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", SOME_ROWS)
def test_query_without_sql_has_rows(spark, tables, name):
    got = queries.queries()[name](spark, tables).collect()
    assert got
    assert not [v for r in got for v in r if isinstance(v, float) and not math.isfinite(v)]
