"""Queries that SQL can say, over the smallest tables."""

import duckdb
import pytest

from wareloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_its_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        duck.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = duck.sql(SQL[name])
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.select(*columns).fetchall()))
