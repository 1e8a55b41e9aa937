"""Every registered table query against its SQL at sf0.001, and a few results by hand."""

import math
import os

import duckdb
import pytest

from kontig.plans import table_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}"
        return "none" if v is None else str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(table_queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = table_queries.QUERIES[name](spark, SF)
    want = duck.execute(table_queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)

    def numbers(r):
        return [float(v) if type(v).__name__ == "Decimal" else v for v in r]

    assert rows(got.columns, [numbers(r) for r in got.collect()]) == rows(columns, [numbers(r) for r in want.fetchall()])


def test_align_dp_runs(spark):
    assert table_queries.align_dp(spark, SF).count() > 0
