"""Every registered query against its SQL on another engine, and known values."""

import os

import duckdb
import pytest
from conftest import ALL, DAY, as_dict

from __spark_entry__ import entry, oracle_sql, queries
from checks.oracle import ORACLE
from checks.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SMALL}/lineitem.parquet'")
    return con


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    result = QUERIES[name](spark, SMALL)
    cursor = duck.execute(ORACLE[name])
    want = comparable([column[0] for column in cursor.description], cursor.fetchall())
    assert want[1], "the comparison is empty"
    assert comparable(result.columns, [tuple(row) for row in result.collect()]) == want


def test_entry(spark):
    assert entry(spark).count() > 0


# Known values: the all-collectors rows of the first two days at scale factor 0.01.
KNOWN = {
    "elem_counts": [(13710, 3369), (13690, 3366)],
    "routing_table": [(1494, 498, 567, 210), (1499, 500, 580, 201)],
    "moas": [(1494, 498, 912, 307, 15, 3, 866, 290), (1499, 500, 918, 303, 14, 7, 866, 282)],
    "transit": [
        (1494, 498, 28, 28, 1473, 493,
         271, 330.142857, 416, 37.776329, 89, 109.964286, 142, 14.722389),
        (1499, 500, 28, 28, 1478, 490,
         274, 332.5, 430, 35.211098, 85, 107.678571, 140, 13.633084),
    ],
    "community": [
        (1494, 498, 1480, 496, 1463, 489, 1475, 494, 23, 23, 266, 181),
        (1499, 500, 1494, 499, 1475, 496, 1486, 497, 23, 23, 266, 181),
    ],
}


@pytest.mark.parametrize("kind", KNOWN)
def test_known_values(spark, kind):
    rows = as_dict(queries()[kind](spark, MEDIUM))
    assert len(rows) == 122
    for day, want in enumerate(KNOWN[kind]):
        row = rows[(day, *ALL[1:])]
        assert row.pop("time") == DAY + day * 86_400
        assert tuple(row.values())[2:] == want
    if kind != "elem_counts":
        empty = [row for row in rows.values() if not any(
            value for name, value in row.items() if name not in ("time", "collector", "peer"))]
        assert len(empty) == 16
