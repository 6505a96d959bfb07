from routelens.sources.account import ReadAccount, RejectedRows, read_elems_with_account
from routelens.sources.catalog import read_collectors
from routelens.sources.elems import flatten_records, read_elems, write_elems
from routelens.sources.scratch import ScratchTables

__all__ = [
    "ReadAccount", "RejectedRows", "ScratchTables", "flatten_records", "read_collectors",
    "read_elems", "read_elems_with_account", "write_elems",
]
