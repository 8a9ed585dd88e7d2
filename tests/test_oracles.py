"""Every query that has an oracle gives the rows that DuckDB gives on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from glosswork.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def rows(names, found):
    return sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_gives_the_oracles_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalogue.ORACLES:
        assert got
        return
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(list(want.columns), want.fetchall())
