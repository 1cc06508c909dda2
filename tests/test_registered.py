"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as e
from tools.check_sql import TABLES, rows_of

SLOW = {"tune_hyperparameters", "tune_all_classifiers", "train_single_model", "train_ensemble"}


@pytest.fixture(scope="module")
def con(tables):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{tables}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(e.oracle_sql()))
def test_query_equals_sql(spark, con, tables, name):
    got = e.queries()[name](spark, tables).toPandas()
    want = con.execute(e.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(e.queries()) - set(e.oracle_sql()) - SLOW))
def test_query_without_sql_runs(spark, tables, name):
    assert e.queries()[name](spark, tables).count() > 0


def test_entry(spark):
    assert e.entry(spark).count() == 1


def test_every_statement_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
