"""Every query with an oracle agrees with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from edgeloom import contract, contract_io  # noqa: F401  contract_io registers its queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(df):
    def cell(x):
        if x is None or x != x:
            return None
        return f"{float(x):.6f}" if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(contract.ORACLES))
def test_oracle(spark, duck, name):
    mine, theirs = contract.QUERIES[name](spark, DIR).toPandas(), duck.execute(contract.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(DIR):
        assert entry.entry(spark).count() > 0
