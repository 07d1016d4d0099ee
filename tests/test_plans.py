"""Every registered plan against its DuckDB SQL on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from sextant.plans import catalog, load  # noqa: F401

SF = os.environ.get("PLANS_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return int(value) if isinstance(value, bool) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = rows_of(got.columns, got.collect()), rows_of(columns, want.fetchall())
    assert len(a) == len(b)
    close = [all(x == y or (isinstance(x, float) and isinstance(y, (float, int)) and abs(x - y) < 2e-5 * max(1, abs(y))) or (not isinstance(x, (float, str)) and x is not None and y is not None and str(x) == str(y)) for x, y in zip(r, s, strict=True)) for r, s in zip(a, b, strict=True)]
    assert all(close), [(r, s) for r, s, ok in zip(a, b, close, strict=True) if not ok][:3]
