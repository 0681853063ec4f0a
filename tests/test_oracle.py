"""Every registered query against its SQL on the smallest tables."""

import os

import oracle
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, connection, name):
    _, _, verdict = oracle.compare(spark, FOLDER, name, QUERIES[name], SQL[name], connection)
    assert verdict == "ok", verdict


# Iterative rules whose operators are held against plain loops in the other tests.
BY_LOOP = {"m12_quality_report", "m17_document_report"}


@pytest.mark.parametrize("name", sorted(BY_LOOP))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_other_query_has_sql():
    assert {n for n in QUERIES.keys() - SQL.keys() if not n.startswith("op") and n != "pipeline"} == BY_LOOP


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0
