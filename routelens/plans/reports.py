"""The five daily reports.

Each takes selected elems (see :func:`routelens.operators.select_elems`) and
returns ``time, collector, peer`` plus the columns of ``REPORT_COLUMNS``, one row
per observed peer, collector and day, or other bucket.

``spans`` are the bucket lengths wanted, the first that of ``time`` in the selected elems. With
more than one, hours' facts are merged to days as peers' are to collectors, and rows have a ``span``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.operators import (
    LEVEL_KEYS,
    climb,
    climb_levels,
    climb_record_bitmaps,
    community_facts,
    label_levels,
    origin_facts,
    origin_sets_by_level,
    record_bitmaps,
    record_facts,
    routing_facts,
    with_longer_spans,
)
from routelens.plans.details import transit_by_level
from routelens.schema import (
    COLLECTOR,
    COLLECTOR_KEYS,
    PEER,
    REPORT_COLUMNS,
    TIME_KEYS,
)

FAMILIES = (4, 6)


def _total(amount: str, condition: str, name: str) -> Column:
    """Sum of an amount over the rows that meet a condition; 0 if none does."""
    return F.expr(f"sum(if({condition}, {amount}, 0)) AS `{name}`")


def _finish(levels: DataFrame, report: str) -> DataFrame:
    return label_levels(levels, *REPORT_COLUMNS[report])


def elem_counts(selected: DataFrame, spans: Sequence[int] = ()) -> DataFrame:
    """Elems and records. A record that several peers share counts once per collector."""
    facts = with_longer_spans(record_facts(selected), spans, ["record_cnt"], ["elem_cnt"])
    rows = facts.withColumn("level", F.lit(PEER))
    rows = climb(rows, PEER, COLLECTOR_KEYS, item=["record_id"],
                 counts=["record_cnt"], sums=["elem_cnt"])
    # A record belongs to one collector, so from here on records add up too.
    rows = climb(rows, COLLECTOR, TIME_KEYS, sums=["elem_cnt", "record_cnt"])
    return _finish(rows, "elem_counts")


def elem_counts_of_close_records(selected: DataFrame) -> DataFrame:
    """The same counts by bitmaps, for record ids that lie close together; none may be NULL."""
    return _finish(climb_record_bitmaps(record_bitmaps(selected)), "elem_counts")


def routing_table(selected: DataFrame, spans: Sequence[int] = ()) -> DataFrame:
    """Unique prefixes, and unique ASNs in their paths."""
    facts = with_longer_spans(routing_facts(selected), spans, ["pfxs", "asns"])
    rows = climb_levels(facts, ["family"], ["prefix", "asn"], ["pfxs", "asns"])
    columns = [_total(name, f"family = {f}", f"{name}_v{f}")
               for name in ("pfxs", "asns") for f in FAMILIES]
    return _finish(rows.groupBy(*LEVEL_KEYS).agg(*columns), "routing_table")


def moas(selected: DataFrame, spans: Sequence[int] = ()) -> DataFrame:
    """Prefixes by number of origins, and distinct sets of several origins."""
    # One row per level, family and origin set. Prefixes with none or one share a row.
    sets = origin_sets_by_level(with_longer_spans(origin_facts(selected), spans))
    columns = []
    for f in FAMILIES:
        columns += [
            _total("pfxs", f"family = {f}", f"total_v{f}"),
            _total("pfxs", f"family = {f} AND kind > 1", f"moas_pfxs_v{f}"),
            _total("pfxs", f"family = {f} AND kind = 0", f"unknown_origin_pfxs_v{f}"),
            _total("1L", f"family = {f} AND kind > 1", f"origin_sets_v{f}"),
        ]
    return _finish(sets.groupBy(*LEVEL_KEYS).agg(*columns), "moas")


def transit(selected: DataFrame, spans: Sequence[int] = ()) -> DataFrame:
    """Transit ASes, and statistics of the number of prefixes per transit AS."""
    columns = []
    for f in FAMILIES:
        prefixes = f"if(family = {f} AND transit IS NOT NULL, pfxs, NULL)"
        columns += [
            _total("pfxs", f"family = {f} AND transit IS NULL", f"total_v{f}"),
            _total("1L", f"family = {f} AND transit IS NOT NULL", f"transit_asns_v{f}"),
            _total("via", f"family = {f} AND transit IS NULL", f"transit_pfxs_v{f}"),
            F.expr(f"coalesce(min({prefixes}), 0) AS min_pfxs_v{f}"),
            F.expr(f"coalesce(avg({prefixes}), 0) AS mean_pfxs_v{f}"),
            F.expr(f"coalesce(max({prefixes}), 0) AS max_pfxs_v{f}"),
            F.expr(f"coalesce(stddev_pop({prefixes}), 0) AS std_pfxs_v{f}"),
        ]
    return _finish(transit_by_level(selected, spans).groupBy(*LEVEL_KEYS).agg(*columns), "transit")


def community(selected: DataFrame, spans: Sequence[int] = ()) -> DataFrame:
    """Prefixes with communities of any, the peer's own or another AS; their ASNs and values."""
    counts = ("pfxs", "any", "int", "ext", "pairs")
    facts = with_longer_spans(community_facts(selected), spans, counts)
    rows = climb_levels(facts, ["family", "asn"], ["prefix", "value"], counts)
    per_asn = rows.groupBy(*LEVEL_KEYS, "family", "asn").agg(
        *[F.sum(name).alias(name) for name in counts])
    columns = []
    for f in FAMILIES:
        columns += [
            _total("pfxs", f"family = {f}", f"total_ipv{f}"),
            *[_total(f"`{kind}`", f"family = {f}", f"pfx_v{f}_{kind}")
              for kind in ("any", "int", "ext")],
            _total("1L", f"family = {f} AND pairs > 0", f"asn_v{f}"),
            _total("pairs", f"family = {f}", f"asn_value_v{f}"),
        ]
    return _finish(per_asn.groupBy(*LEVEL_KEYS).agg(*columns), "community")


REPORTS = {
    "elem_counts": elem_counts,
    "routing_table": routing_table,
    "moas": moas,
    "transit": transit,
    "community": community,
}
