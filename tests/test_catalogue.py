"""Every query of the catalogue against DuckDB on the smallest tables."""

import duckdb
import pytest

from lattica import catalogue

TABLES = "customer events embeddings lineitem nation orders part region supplier".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(None if v is None or v != v else str(v) if isinstance(v, str) else float(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, sf_dir, name):
    assert rows(catalogue.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(catalogue.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
