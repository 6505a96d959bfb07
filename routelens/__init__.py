"""Daily statistics over BGP routing data, as Spark DataFrames."""

from routelens.job import (
    build_details,
    build_report,
    read_details,
    read_report,
    run_details,
    run_report,
    run_reports,
    update_report,
)
from routelens.operators import select_elems
from routelens.plans import DETAILS, REPORTS, to_legacy_layout
from routelens.sources import (
    RejectedRows,
    flatten_records,
    read_collectors,
    read_elems,
    read_elems_with_account,
    write_elems,
)

__all__ = [
    "DETAILS", "REPORTS", "RejectedRows", "build_details", "build_report", "flatten_records",
    "read_collectors", "read_details", "read_elems", "read_elems_with_account", "read_report",
    "run_details", "run_report", "run_reports", "select_elems", "to_legacy_layout",
    "update_report", "write_elems",
]
