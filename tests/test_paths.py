"""Path expressions against what they mean in plain Python."""

import itertools

import pytest
from pyspark.sql import functions as F

from routelens import functions as R

PATHS = [
    None, "", " ", "   ", "1", " 1", "1 ", "1 2", "1  2", "1   2", " 1 2 ", "1\t2", "1\t", "\t",
    "1 2\n", "1\x0b2", "1\f2\r", "1 1", "1 1 1", "1 1 2 2 1 3 3", "1 12 1", "12 1", "1 1 12",
    "11 1 1", "{1,2} {1,2} 3", "1 {1,2}", "1 23456", "1 1\t1 1", "  1", "1 2 1 2 1",
    "$1 $1 \\1", "1" + " 1" * 20_000 + " 2 3",
    *[" ".join(hops) for hops in itertools.product(["1", "12", ""], repeat=4)],
]


@pytest.fixture(scope="module")
def rows(spark):
    path = F.col("p")
    df = spark.createDataFrame(list(enumerate(PATHS)), "i int, p string").select(
        "i", R.tokens(path).alias("tokens"), R.origin(path).alias("origin"),
        R.squash(path).alias("squashed"), R.hops(path).alias("hops"),
        R.interior(R.hops(path)).alias("interior"),
        R.is_valid_origin(R.origin(path)).alias("valid"))
    return {row["i"]: row for row in df.collect()}


@pytest.mark.parametrize("i", range(len(PATHS)))
def test_path(rows, i):
    path, row = PATHS[i], rows[i]
    if path is None:
        assert row["tokens"] is None and row["origin"] == "" and row["hops"] is None
        return
    last = path.split()[-1] if path.split() else ""
    squashed = [hop for hop, _ in itertools.groupby(path.split(" "))]
    assert row["tokens"] == path.split()
    assert row["origin"] == last
    assert row["valid"] == (last not in ("", "23456") and "{" not in last)
    assert row["hops"] == squashed
    assert row["squashed"] == " ".join(squashed)
    assert row["interior"] == squashed[1:-1]
