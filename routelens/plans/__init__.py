from collections.abc import Iterable

from routelens.plans.details import (
    DETAILS,
    community_detail,
    moas_detail,
    prefix_origins,
    transit_detail,
)
from routelens.plans.legacy import to_legacy_layout
from routelens.plans.reports import (
    REPORTS,
    community,
    elem_counts,
    elem_counts_of_close_records,
    moas,
    routing_table,
    transit,
)

_OF_PATHS = ("prefix", "as_path")
_OF_COMMUNITIES = ("prefix", "communities")
_FIELDS = {
    "elem_counts": (), "routing_table": _OF_PATHS, "moas": _OF_PATHS, "transit": _OF_PATHS,
    "community": _OF_COMMUNITIES, "prefix_origins": _OF_PATHS, "moas_detail": _OF_PATHS,
    "transit_detail": _OF_PATHS, "community_detail": _OF_COMMUNITIES,
}


def elem_fields(kinds: Iterable[str]) -> set[str]:
    """The fields of an elem that these reports and tables read."""
    return {"peer_asn", "peer_address"}.union(*[_FIELDS[kind] for kind in kinds])


__all__ = [
    "DETAILS", "REPORTS", "community", "community_detail", "elem_counts",
    "elem_counts_of_close_records", "elem_fields",
    "moas", "moas_detail",
    "prefix_origins", "routing_table", "to_legacy_layout", "transit", "transit_detail",
]
