"""Exact distinct counts per peer, per collector and over everything.

The counts do not add up from level to level: a prefix that two peers see counts
once at their collector. So each level needs the facts themselves. But a level
needs them only until it is counted, so the levels are climbed one by one:

1. The facts are distinct per peer. Counting a peer is a plain sum, which
   collapses inside each task. In the same pass the facts lose their peer and
   are merged per collector.
2. The collectors are counted the same way, while their facts, now far fewer,
   are merged over all collectors.

Each step is one ``GROUPING SETS`` of two sets. Peer facts thus cross the network
once to be deduped and once to be merged, collector facts once, and nothing is
tripled. No group is ever gathered in one place: every step is a hash aggregate
over sums that combines before its shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.functions import peer_label
from routelens.operators.periods import time_columns
from routelens.schema import (
    ALL_COLLECTORS,
    ALL_PEERS,
    COLLECTOR,
    COLLECTOR_KEYS,
    EVERYTHING,
    PEER,
    PEER_KEYS,
    TIME_KEYS,
)

# What identifies a report row. A rolled-up key is NULL; ``level`` tells it from
# a NULL in the data.
LEVEL_KEYS = (*PEER_KEYS, "level")


def climb(rows: DataFrame, level: int, upper_keys: Sequence[str], by: Sequence[str] = (),
          item: Sequence[str] = (), counts: Sequence[str] = (), sums: Sequence[str] = (),
          marks: Mapping[str, tuple[str, str]] = MappingProxyType({})) -> DataFrame:
    """Count the facts of ``level`` and merge them for the level above.

    ``rows`` holds distinct facts at ``level`` and rows already counted at the
    levels below, which pass through. In the result the facts of ``level`` are
    counted (``item`` is NULL), and next to them stand the facts distinct over
    ``upper_keys``, at ``level + 1``. ``counts`` are 0/1 columns, and stay so for
    merged facts; ``sums`` simply add up. ``marks`` names columns with an aggregate
    function each, and the expression that gives a merged fact its value again.
    """
    counted = [*LEVEL_KEYS, *by]
    merged = [*upper_keys, "level", *by, *item]
    return (
        rows.groupingSets([counted, merged], *LEVEL_KEYS, *by, *item)
        .agg(F.expr("grouping(peer_address) = 1 AS is_merged"),
             *[F.sum(name).alias(name) for name in (*counts, *sums)],
             *[F.expr(f"{merge}({name}) AS {name}") for name, (merge, _) in marks.items()])
        .where(f"NOT is_merged OR level = {level}")
        .select(
            *PEER_KEYS,
            F.expr(f"if(is_merged, {level + 1}, level) AS level"),
            *by, *item,
            *[F.expr(f"if(is_merged, least(`{name}`, 1), `{name}`) AS `{name}`")
              for name in counts],
            *sums,
            *[F.expr(f"if(is_merged, {of_item}, {name}) AS {name}")
              for name, (_, of_item) in marks.items()],
        )
    )


def climb_levels(facts: DataFrame, by: Sequence[str], item: Sequence[str],
                 counts: Sequence[str]) -> DataFrame:
    """Climb all levels with facts that are distinct per peer.

    The rows still want a sum: adding up ``counts`` per ``LEVEL_KEYS`` and ``by``
    gives the number of distinct items.
    """
    rows = facts.withColumn("level", F.lit(PEER))
    rows = climb(rows, PEER, COLLECTOR_KEYS, by, item, counts)
    rows = climb(rows, COLLECTOR, TIME_KEYS, by, item, counts)
    return rows


def label_levels(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """Replace the level keys by the three report labels, and ``span`` where there are several."""
    peer = peer_label(F.col("peer_asn"), F.col("peer_address"))
    return rows.select(
        *time_columns(rows),
        F.expr(f"if(level = {EVERYTHING}, '{ALL_COLLECTORS}', collector) AS collector"),
        F.when(F.col("level") == PEER, peer).otherwise(ALL_PEERS).alias("peer"),
        *columns,
    )
