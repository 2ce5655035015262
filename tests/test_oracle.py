"""Every named query against the checking database on the same tables."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as E

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def _rows(rows, order):
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_same_rows(spark, db, sf_dir, name):
    df = E.queries()[name](spark, sf_dir)
    result = db.execute(E.oracle_sql()[name])
    names = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    expected = result.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    columns = sorted(names)
    assert _rows(df.collect(), [df.columns.index(c) for c in columns]) == _rows(
        expected, [names.index(c) for c in columns])
    assert expected, "an empty result checks nothing"


def test_every_query_is_checked_or_known_not_to_be():
    own = {name for name in E.queries() if not re.match(r"op\d+_|pipeline$", name)}
    assert own - set(E.oracle_sql()) == {"cv_benchmark"}


def test_entry(spark):
    assert E.entry(spark).count() > 0
