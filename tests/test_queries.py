"""Registered queries against their SQL on the smallest data; QUERIES=all runs every one."""

import os

import duckdb
import pytest

from workload import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("pages", "orders")
QUICK = ("normalize_link", "change_counts", "link_decisions", "document_files", "stream_progress", "page_metadata_fields")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("QUERIES") == "all" else QUICK)
def test_query_equals_its_sql(spark, database, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    result = sorted(repr(tuple(row[c] for c in columns)) for row in frame.collect())
    cursor = database.execute(ORACLES[name])
    given = [d[0] for d in cursor.description]
    assert sorted(given) == columns
    places = [given.index(c) for c in columns]
    assert result == sorted(repr(tuple(row[i] for i in places)) for row in cursor.fetchall())


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)
