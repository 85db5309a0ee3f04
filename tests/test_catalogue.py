"""Each registered wave-field query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from wavefold.plans import catalogue, volume_queries  # noqa: F401  (each registers its queries)
from wavefold.plans.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, oracle, name):
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), oracle.sql(ORACLE_SQL[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert len(a) == len(b)
    for c in columns:
        assert (a[c].astype(str) == b[c].astype(str)).all(), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
