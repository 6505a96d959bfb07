"""The reports under the column titles and counting rules of the older tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.schema import REPORT_COLUMNS

# Titles, in order, and the columns they show. The element and
# record counts have no older layout.
_ROUTING_TABLE = {
    "#Pfxs_v4": "pfxs_v4",
    "#Pfxs_v6": "pfxs_v6",
    "#ASNs_v4": "asns_v4",
    "#ASNs_v6": "asns_v6",
}
_MOAS = {
    "Total_IPv4": "total_v4",
    "Total_IPv6": "total_v6",
    "#Pfxs_v4": "moas_pfxs_v4",
    "#Pfxs_v6": "moas_pfxs_v6",
    "#Origin_Sets_IPv4": "origin_sets_v4",
    "#Origin_Sets_IPv6": "origin_sets_v6",
}
_TRANSIT = {
    "Total_IPv4": "total_v4",
    "Total_IPv6": "total_v6",
    "#Pfxs_v4": "transit_asns_v4",
    "#Pfxs_v6": "transit_asns_v6",
    "#Min_Pfxs_v4": "min_pfxs_v4",
    "#Mean_Pfxs_v4": "mean_pfxs_v4",
    "#Max_Pfxs_v4": "max_pfxs_v4",
    "#Std_Pfxs_v4": "std_pfxs_v4",
    "#Min_Pfxs_v6": "min_pfxs_v6",
    "#Mean_Pfxs_v6": "mean_pfxs_v6",
    "#Max_Pfxs_v6": "max_pfxs_v6",
    "#Std_Pfxs_v6": "std_pfxs_v6",
}
_COMMUNITY = dict(zip(
    ("Total_IPv4", "Total_IPv6", "#Pfx_v4_ANY", "#Pfx_v6_ANY", "#Pfx_v4_Int", "#Pfx_v6_Int",
     "#Pfx_v4_Ext", "#Pfx_v6_Ext", "#ASN_v4", "#ASN_v6", "#ASN-Value_v4", "#ASN-Value_v6"),
    REPORT_COLUMNS["community"],
))
_LAYOUTS = {
    "routing_table": _ROUTING_TABLE,
    "moas": _MOAS,
    "transit": _TRANSIT,
    "community": _COMMUNITY,
}


def to_legacy_layout(report: DataFrame, kind: str) -> DataFrame:
    """Rename a report's columns.

    Two reports also count differently there. A prefix without a known origin
    counts as a multi-origin prefix, and the empty set as one more origin set.
    The transit prefix count is the number of transit ASes.
    """
    if kind not in _LAYOUTS:
        raise ValueError(f"no legacy layout for {kind!r}, only for {sorted(_LAYOUTS)}")
    if kind == "moas":
        for v in ("v4", "v6"):
            unknown = F.col(f"unknown_origin_pfxs_{v}")
            report = (
                report
                .withColumn(f"moas_pfxs_{v}", F.col(f"moas_pfxs_{v}") + unknown)
                .withColumn(f"origin_sets_{v}",
                            F.col(f"origin_sets_{v}") + (unknown > 0).cast("long"))
            )
    return report.select(
        *[F.col(name).alias(name.capitalize()) for name in ("time", "span", "collector", "peer")
          if name in report.columns],
        *[F.col(name).alias(title) for title, name in _LAYOUTS[kind].items()],
    )
