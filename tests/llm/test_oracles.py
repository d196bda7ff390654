"""Queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from veilspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLES[name]).to_arrow_table()
    got = QUERIES[name](spark, SF)
    assert set(got.columns) == set(want.column_names)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(rows) == sorted(zip(*(want.column(c).to_pylist() for c in columns), strict=True))
