import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from discern.plans import oracle, queries

NAMES = sorted(queries.queries())


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(tuple, frame.map(str).to_numpy()))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, data, duck, name):
    got = queries.queries()[name](spark, data).toPandas()
    assert len(got)
    if name in oracle.sql():
        assert rows(got) == rows(duck.execute(oracle.sql()[name]).df())


def test_contract(spark):
    assert set(oracle.sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
