"""Routing elems derived from a ``lineitem`` table.

There is no routing data among the test tables, so each lineitem row becomes one
elem by fixed arithmetic on its columns. The result has peers without any
prefix, several origins per prefix, prepending, AS sets and communities of the
peer and of others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The parts that several columns share.
_PARTS = (
    "*",
    "string(64500 + l_suppkey % 7) AS peer",
    "string(1000 + l_orderkey % 17) AS first_transit",
    """CASE WHEN l_orderkey % 5 = 0 THEN 'R'
            WHEN l_suppkey % 7 = 6 THEN 'S'
            WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'W'
            ELSE 'A' END AS elem_type""",
    """CASE WHEN l_discount > 0.095 THEN '23456'
            WHEN l_tax > 0.075 THEN '{65001,65002}'
            WHEN l_quantity > 48 THEN string(40000 + l_partkey % 500)
            ELSE string(30000 + l_partkey % 500) END AS path_end""",
    "named_struct('asn', 64500 + l_suppkey % 7, 'value', l_orderkey % 20) AS own",
    "named_struct('asn', 1000 + l_orderkey % 17, 'value', l_partkey % 10) AS foreign",
)

_ELEM_COLUMNS = (
    "l_orderkey AS record_id",
    """CASE WHEN l_orderkey % 7 <= 2 THEN 'routeviews'
            WHEN l_orderkey % 7 <= 5 THEN 'ris'
            ELSE 'other' END AS project""",
    """CASE WHEN l_orderkey % 7 <= 1 THEN 'route-views.sg'
            WHEN l_orderkey % 7 = 2 THEN 'route-views2'
            WHEN l_orderkey % 7 <= 4 THEN 'rrc00'
            WHEN l_orderkey % 7 = 5 THEN 'rrc01'
            ELSE 'other00' END AS collector""",
    "if(l_orderkey % 5 = 0, 'ribs', 'updates') AS record_type",
    "1451606400 + (l_orderkey % 3) * 86400 + (l_orderkey * 37) % 86400 AS record_time",
    "64500 + l_suppkey % 7 AS peer_asn",
    """if(l_suppkey % 5 = 0, '2001:db8::', '192.0.2.') || string(l_suppkey % 7)
       AS peer_address""",
    """CASE WHEN elem_type = 'S' THEN NULL
            WHEN l_partkey % 4 = 0 THEN '2001:db8:' || string(l_partkey % 9000) || '::/48'
            ELSE '10.' || string((l_partkey div 256) % 256) || '.'
                 || string(l_partkey % 256) || '.0/24' END AS prefix""",
    """CASE WHEN elem_type NOT IN ('R', 'A') THEN NULL
            WHEN l_linenumber = 7 THEN ''
            WHEN l_linenumber = 6 THEN peer
            ELSE concat_ws(' ', peer, if(l_linenumber = 3, peer, NULL),
                           first_transit, if(l_linenumber = 2, first_transit, NULL),
                           if(l_linenumber = 4, NULL, string(2000 + l_suppkey % 11)),
                           path_end) END AS as_path""",
    """CASE WHEN elem_type NOT IN ('R', 'A') THEN NULL
            WHEN l_linenumber = 5 THEN slice(array(own), 1, 0)
            WHEN l_linenumber = 1 THEN array(own)
            WHEN l_linenumber = 2 THEN array(foreign)
            ELSE array(own, foreign) END AS communities""",
    "elem_type",
)


def elems_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.selectExpr(*_PARTS).selectExpr(*_ELEM_COLUMNS)
