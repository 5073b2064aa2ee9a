"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from relflow import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        return round(x, 6) if isinstance(x, float) and math.isfinite(x) else x

    return sorted(names), sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalog.SQL:
        assert got[1]
        return
    cur = duck.execute(catalog.SQL[name])
    assert got == rows([c[0] for c in cur.description], cur.fetchall())


def test_whole_tables_pass_the_joins_and_sets(spark):
    def size(name):
        return spark.read.parquet(f"{SF}/{name}.parquet").count()

    left = catalog.QUERIES["join_left"](spark, SF).select("o_orderkey").distinct()
    right = catalog.QUERIES["join_right"](spark, SF).select("c_custkey").distinct()
    assert (left.count(), right.count()) == (size("orders"), size("customer"))
    grouped = catalog.QUERIES["cogroup_full"](spark, SF).toPandas()
    assert (grouped.na.sum(), grouped.nb.sum()) == (size("orders"), size("customer"))
    assert catalog.QUERIES["concat"](spark, SF).count() == size("customer") + size("supplier") + size("nation")
    subsets = ("o_orderkey % 20 = 0", "o_orderkey % 10 = ", "c_custkey < 100")
    assert not [n for n, q in catalog.SQL.items() if any(x in q for x in subsets)]
