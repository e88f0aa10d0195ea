import glob
import os

import duckdb
import pytest

from discern.llm.queries import SQL, queries


@pytest.mark.parametrize("name", SQL)
def test_base_columns_match_sql(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want, got = con.execute(SQL[name]).df(), queries()[name](spark, data).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and len(got)
    shown = lambda frame: sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).map(lambda x: str(int(x)) if isinstance(x, float) else str(x)).to_numpy()))
    assert shown(got) == shown(want)
