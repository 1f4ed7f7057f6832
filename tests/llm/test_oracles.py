"""Queries with SQL give DuckDB's rows."""

import glob
import os

import duckdb
import pytest

from tessera.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(frame):
    names = sorted(frame.columns)
    return sorted(tuple(str(x) for x in r) for r in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    want, got = con.execute(queries.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
