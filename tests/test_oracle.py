"""Every registered query against its SQL on the smallest supplied tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
import check

SF = "/root/testdata/sf0.001"
ORACLE = entry_points.oracle_sql()
QUERIES = entry_points.queries()
# Fits of many models; their behaviour is tested in test_models.py.
SLOW = {n for n in QUERIES if n.startswith(("ml4", "ml5", "ml6", "ml7", "ml8", "ml10", "ml11", "ml12", "ml13", "ml14"))}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert check.compare(df, duck, ORACLE[name]) in ("", "empty")
    else:
        assert df.columns


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0
    assert {"subject", "win", "label", "value_mean"} <= set(df.columns)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
