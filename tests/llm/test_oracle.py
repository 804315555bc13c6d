"""The queries that SQL can express give its rows."""

import duckdb
import pytest

from quillstone.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    df = QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(got.fetchall()) == sorted(tuple(r[c] for c in columns) for r in df.collect())
