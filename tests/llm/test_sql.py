"""The queries that have SQL, against it."""

from pathlib import Path

import duckdb
import pytest

from relflow.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    df = QUERIES[name](spark, d)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cur.fetchall())
