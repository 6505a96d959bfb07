"""The registered training-data queries that have SQL, against it, and how the rest are registered."""

import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from routelens.llm.oracle import ORACLE
from routelens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, duck, name):
    result = QUERIES[name](spark, SMALL)
    cursor = duck.execute(ORACLE[name])
    want = comparable([column[0] for column in cursor.description], cursor.fetchall())
    assert comparable(result.columns, [tuple(row) for row in result.collect()]) == want


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(queries()) and set(ORACLE) <= set(oracle_sql())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
