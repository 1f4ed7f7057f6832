"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import corpus_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(frame):
    names = sorted(frame.columns)
    return sorted(tuple(str(x) for x in r) for r in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(corpus_queries.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = corpus_queries.QUERIES[name](spark, SF).toPandas()
    if name in corpus_queries.ORACLE_SQL:
        want = duck.execute(corpus_queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_selection_of_pages_that_share_a_url(spark, tmp_path):
    pages = [(1, "http://a/x"), (2, "http://a/x"), (3, "http://b"), (4, "http://blog/b"), (5, "http://c"), (5, "http://c"), (6, None), (None, "http://d"), (8, ""), (9, "")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = corpus_queries.QUERIES["selection_intersect"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(corpus_queries.ORACLE_SQL["selection_intersect"]).df()
    assert rows(got) == rows(want) == [("",), ("http://a/x",), ("http://c",), ("http://c",)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
