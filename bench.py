"""Seconds per report. Prints one JSON line.

``queries`` holds the best of the warm runs, ``cold`` the first run of each query
in this session, and ``count_distinct_form`` the same routing-table counts written
as ``count(DISTINCT ...)`` over grouping sets, for comparison.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.queries import QUERIES, updates
from routelens.functions import family, tokens
from routelens.schema import COLLECTOR_KEYS, PEER_KEYS, TIME_KEYS

HEADLINE = (
    "elem_counts", "routing_table", "moas", "transit", "community",
    "moas_detail", "transit_detail", "community_detail",
)
WARM_RUNS = 3


def count_distinct_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = updates(spark, sf_dir).select(
        *PEER_KEYS, "prefix", family(F.col("prefix")).alias("family"),
        F.explode_outer(F.when(F.col("prefix").isNotNull(), tokens(F.col("as_path")))).alias("asn"))
    return rows.groupingSets([PEER_KEYS, COLLECTOR_KEYS, TIME_KEYS], *PEER_KEYS).agg(*[
        F.expr(f"count(DISTINCT if(family = {f}, {item}, NULL)) AS {item}_v{f}")
        for item in ("prefix", "asn") for f in (4, 6)
    ])


def seconds(spark: SparkSession, query, sf_dir: str) -> float:
    """Time to build, plan and run a query; its rows are computed and dropped."""
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("routelens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    cold, warm = {}, {}
    for name in HEADLINE:
        cold[name] = round(seconds(spark, QUERIES[name], sf_dir), 3)
        warm[name] = round(min(seconds(spark, QUERIES[name], sf_dir)
                               for _ in range(WARM_RUNS)), 3)
    naive = min(seconds(spark, count_distinct_form, sf_dir) for _ in range(WARM_RUNS + 1))
    print(json.dumps({
        "metric": "total warm seconds of the headline queries",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "count_distinct_form": {"routing_table": round(naive, 3)},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
