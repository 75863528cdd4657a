"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from echofold.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, columns):
    part = frame[columns].astype(object)
    return sorted(map(repr, part.where(part.notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        path = f"/root/testdata/sf0.001/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, data, database, name):
    found, expected = QUERIES[name](spark, data).toPandas(), database.execute(ORACLES[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert rows(found, columns) == rows(expected, columns)


def test_entry(spark, data):
    assert contract.entry(spark).count() > 0


def test_contract_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())
