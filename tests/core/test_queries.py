"""Every query against its SQL on the smallest tables; those without run."""

import os

import duckdb
import pytest

from veilspark.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(map(repr, (tuple(r) for r in got.select(*columns).collect())))
    if name not in ORACLES:
        assert rows or name in ("aggressive_documents", "sanitized_pages")
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(ORACLES[name]).to_arrow_table()
    assert sorted(want.column_names) == columns
    assert rows == sorted(map(repr, zip(*(want.column(c).to_pylist() for c in columns), strict=True)))


def test_merged_parts_hold_all_rows(spark, tmp_path):
    """Null and negative identifiers are in one of the two parts."""
    name, mails = "mail_replacements_merged", [(None, "ann@corp-mail.com"), (-1, "bob@corp-mail.com"), (-2, "cid@corp-mail.com"), (2, "dan@corp-mail.com"), (3, "eve@corp-mail.com")]
    docs = spark.createDataFrame([(i, f"write to {m} today") for i, m in mails], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select("original", "n", "first_doc", "replacement").collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT original, n, first_doc, replacement FROM ({ORACLES[name]})").fetchall(), key=repr)
    assert [r[0] for r in got] == [m for _, m in mails]
