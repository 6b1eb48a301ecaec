"""Every registered query against its DuckDB oracle on the smallest data."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from check import TABLES, duck_rows, spark_rows
from tests.conftest import SF_SMALL

pytestmark = pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "patient_id"


@pytest.mark.parametrize("key", sorted(E.queries()))
def test_query_matches_oracle(spark, duck, key):
    scols, srows, sn = spark_rows(E.queries()[key](spark, SF_SMALL))
    sql = E.oracle_sql().get(key)
    if sql is None:
        assert sn >= 0
        return
    dcols, drows, dn = duck_rows(duck, sql)
    assert scols == dcols
    assert sn == dn
    assert srows == drows
