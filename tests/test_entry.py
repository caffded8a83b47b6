import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from stratalake.plans import catalogue

DATA = "/root/testdata/sf0.001"
CHECKED = sorted(catalogue.oracle_sql())


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, con, name):
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    columns = [c[0] for c in con.description]
    got = entry.queries()[name](spark, DATA).select(*[f"`{c}`" for c in columns]).collect()
    key = lambda r: [str(round(v, 6) + 0.0 if isinstance(v, float) else v)[:19] for v in r]
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_all_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
