"""Column names and types shared by every stage."""

from __future__ import annotations

from pyspark.sql import types as T

DAY_SECONDS = 86_400

# The record types and the two collector projects a report may cover.
RECORD_TYPES = ("ribs", "updates")
PROJECTS = ("routeviews", "ris")

COMMUNITY = T.StructType([
    T.StructField("asn", T.LongType()),
    T.StructField("value", T.LongType()),
])

# One routing statement of one peer. ASNs are 32-bit unsigned, hence Long.
ELEM = T.StructType([
    T.StructField("peer_asn", T.LongType()),
    T.StructField("peer_address", T.StringType()),
    T.StructField("prefix", T.StringType()),
    T.StructField("as_path", T.StringType()),
    T.StructField("communities", T.ArrayType(COMMUNITY)),
    T.StructField("elem_type", T.StringType()),
])

RECORD = T.StructType([
    T.StructField("record_id", T.LongType()),
    T.StructField("project", T.StringType()),
    T.StructField("collector", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("record_time", T.LongType()),
])

# The flat input table: one row per elem, carrying the fields of its record.
ELEMS = T.StructType(RECORD.fields + ELEM.fields)

# The same data with the elems still inside their record.
NESTED_RECORDS = T.StructType(RECORD.fields + [T.StructField("elems", T.ArrayType(ELEM))])

COLLECTORS_FILE = T.StructType([
    T.StructField("data", T.StructType([
        T.StructField("collectors", T.MapType(
            T.StringType(),
            T.StructType([T.StructField("project", T.StringType())]),
        )),
    ])),
])

# A vantage point is (project, collector, peer_asn, peer_address). Each level
# drops keys of the one before it.
PEER_KEYS = ("time", "collector", "project", "peer_asn", "peer_address")
COLLECTOR_KEYS = ("time", "collector")
TIME_KEYS = ("time",)

PEER, COLLECTOR, EVERYTHING = 0, 1, 2

LABELS = ("time", "collector", "peer")
ALL_PEERS = "ALL-PEERS"
ALL_COLLECTORS = "ALL-COLLECTORS"


def _both(*names: str) -> tuple[str, ...]:
    return tuple(f"{name}_{family}" for name in names for family in ("v4", "v6"))


def _stats(family: str) -> tuple[str, ...]:
    return tuple(f"{stat}_pfxs_{family}" for stat in ("min", "mean", "max", "std"))


REPORT_COLUMNS = {
    "elem_counts": ("elem_cnt", "record_cnt"),
    "routing_table": _both("pfxs", "asns"),
    "moas": _both("total", "moas_pfxs", "unknown_origin_pfxs", "origin_sets"),
    "transit": _both("total", "transit_asns", "transit_pfxs") + _stats("v4") + _stats("v6"),
    "community": (
        "total_ipv4", "total_ipv6",
        "pfx_v4_any", "pfx_v6_any",
        "pfx_v4_int", "pfx_v6_int",
        "pfx_v4_ext", "pfx_v6_ext",
        "asn_v4", "asn_v6",
        "asn_value_v4", "asn_value_v6",
    ),
}

#: Directory column of a table laid out by ``write_elems``. Reserved: a column that is merely
#: called ``day`` has no influence on a report.
LAYOUT_DAY = "routelens_day"
