"""Every registered query with an SQL twin, on the smallest tables."""
import duckdb
import pytest
from check import TABLES, compare

from termflow.plans import load_all

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(load_all()))
def test_matches_sql(spark, con, name):
    message, good = compare(spark, con, load_all()[name], SF)
    assert good, message
