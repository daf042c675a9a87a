"""The queries of the package over the smallest tables, against their SQL where there is any."""

import glob
import os

import duckdb
import pytest

from gleanery.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA)
    rows = sorted(map(str, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect())))
    if name not in ORACLES:
        return
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    at = [columns.index(c) for c in sorted(columns)]
    assert sorted(columns) == sorted(got.columns)
    assert rows == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())
