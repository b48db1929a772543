"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from blinkframe.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{FOLDER}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name not in ORACLE_SQL:
        assert len(got.columns)
        return
    want = con.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    text = lambda t: sorted(t[columns].astype(str).agg("|".join, axis=1)) if len(t) else []
    assert text(got) == text(want)
