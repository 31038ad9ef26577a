"""Every query of the cohort operators that has SQL gives the rows of its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from cohortmill.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    d = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "part", "supplier", "nation", "region"):
        d.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = d.sql(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall()
    assert want
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
