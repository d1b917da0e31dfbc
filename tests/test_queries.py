"""Every query with SQL against DuckDB on the smallest driver tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cellframe import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-5)
    return a == b


def key(row):
    return tuple((v is None, round(v, 3) if isinstance(v, float) else str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    other = [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in (r[names.index(c)] for c in columns)) for r in found.fetchall()]
    assert len(rows) == len(other)
    assert all(same(a, b) for x, y in zip(sorted(rows, key=key), sorted(other, key=key), strict=True) for a, b in zip(x, y, strict=True))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries()) and set(catalog.oracle_sql()) <= set(entry.oracle_sql())
