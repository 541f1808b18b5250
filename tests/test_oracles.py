"""Every query with SQL against DuckDB on the smallest tables."""

import os
from pathlib import Path

import pytest

from tessera.oracles import ORACLES
from tessera.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = Path(os.environ.get("TESSERA_DATA", "/root/testdata/sf0.001"))


def rows(df):
    df = df[sorted(df.columns)]
    show = lambda v: "null" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
