"""A second derived table, with the rows that the first does not have.

Empty prefixes, doubled, leading and trailing blanks, tabs, a first hop that comes back at the end,
and an AS set in mid-path. The same expressions as plain SQL are in ``checks.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.schema import ELEM, RECORD

_PREFIX = "if(prefix IS NOT NULL AND record_id % 11 = 0, '', prefix)"
_PATH = """CASE record_id % 6
    WHEN 1 THEN replace(as_path, ' ', '  ')
    WHEN 2 THEN as_path || ' ' || string(peer_asn)
    WHEN 3 THEN ' ' || as_path || '   '
    WHEN 4 THEN replace(as_path, ' ', '\t')
    WHEN 5 THEN string(peer_asn) || ' {1,2} ' || as_path
    ELSE as_path END"""


def edges_of(elems: DataFrame) -> DataFrame:
    return elems.withColumns({"prefix": F.expr(_PREFIX), "as_path": F.expr(_PATH)})


def records_of(elems: DataFrame) -> DataFrame:
    """The elems put back into their records."""
    inside = [field.name for field in ELEM.fields]
    return elems.groupBy(*[field.name for field in RECORD.fields]).agg(
        F.collect_list(F.struct(*inside)).alias("elems"))
