"""Every registered query against DuckDB on the same tables: names, types and values."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from martwright.plans import oracle
from martwright.plans import queries as registered

QUERIES = registered.queries()
ORACLES = oracle.oracle_sql()
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_matches_duckdb(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    expected = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    types = dict(zip(expected.columns, map(str, expected.types)))
    assert dict(df.dtypes) == {c: TYPES[t] for c, t in types.items()}
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    want = sorted(repr(r) for r in expected.select(*columns).fetchall())
    assert got == want


def test_entry(spark):
    assert contract.entry(spark).count() > 0
