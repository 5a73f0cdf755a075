"""Every registered query against its SQL on the driver tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from tallylog.catalogue.oracles import ORACLES
from tallylog.catalogue.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield connection
    connection.close()


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(row[i] for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    got_columns, got = _rows(result.columns, [tuple(row) for row in result.collect()])
    cursor = duck.execute(ORACLES[name])
    want_columns, want = _rows([column[0] for column in cursor.description], cursor.fetchall())
    assert got_columns == want_columns
    assert got, "no rows"
    assert got == want, f"extra {list((got - want).items())[:5]} missing {list((want - got).items())[:5]}"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
