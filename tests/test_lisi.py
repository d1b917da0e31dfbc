"""Cells whose neighbours are almost equally far, against DuckDB."""

import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cellframe import catalog


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    # 40 vectors on the axes, all as far from one another, and 12 close together
    at = tmp_path_factory.mktemp("lisi")
    rows = [[float(i == j) for j in range(64)] for i in range(40)] + [[1.0 + i * 0.01 if j == 50 else 0.1 * i if j == 51 else 0.0 for j in range(64)] for i in range(12)]
    table = pa.table({"vec_id": pa.array(range(52), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([i % 5 for i in range(52)], pa.int32())})
    pq.write_table(table, at / "embeddings.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["lisi", "ilisi", "clisi"])
def test_cells_whose_weights_vanish_equal_their_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()[name]).fetchall(), key=str)
    got = sorted((tuple(r) for r in catalog.queries()[name](spark, folder).collect()), key=str)
    assert len(got) == len(want)
    assert all(a == pytest.approx(b, nan_ok=True, abs=2e-5) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))
    if name == "lisi":
        assert sum(math.isnan(r[1]) for r in got) == 40
