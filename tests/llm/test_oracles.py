"""Every query of the subpackage that has SQL, held against it on whole tables: columns, rows and values."""

import glob
import os

import duckdb
import pytest

from skein.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' * os.path.isdir(path)}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted((tuple(map(repr, r)) for r in got.select(*columns).collect()))
    assert rows == sorted(tuple(map(repr, r)) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())
    assert rows
