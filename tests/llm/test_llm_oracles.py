"""The numbered queries that SQL can express give DuckDB's rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from glosswork.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_oracles_rows(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    want = con.sql(queries.ORACLES[name])
    names = list(want.columns)
    got = queries.QUERIES[name](spark, str(DATA)).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
