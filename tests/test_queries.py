"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from quire.plans import QUERIES, SQL


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):
    found = QUERIES[name](spark, sf)
    rows = found.collect()
    if name not in SQL:
        assert rows, "a query without SQL has to find something here; its results are tested elsewhere"
        return
    want = duck.sql(SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    got = Counter(tuple(_plain(r[c]) for c in want.columns) for r in rows)
    assert got == Counter(tuple(map(_plain, r)) for r in want.fetchall())
    assert got, "no rows to compare"
