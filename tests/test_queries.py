"""Every query of the catalogue against its DuckDB SQL, on the test tables."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from tessera.plans import catalogue

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    """A value that compares and sorts: floats to nine digits, structs as tuples of values."""
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_every_query_is_registered_once():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
    assert len(set(catalogue.NAMES)) == len(catalogue.NAMES)


@pytest.mark.parametrize("name", catalogue.NAMES)
def test_query_matches_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF_DIR)
    rows = rows_of(found.columns, [tuple(r) for r in found.collect()])
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    wanted = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows == rows_of(columns, wanted.fetchall())


def test_flagship(spark):
    assert catalogue.flagship(spark, SF_DIR).count() > 0
