"""Tables behind the reports, one row per prefix, transit AS or community and level.

``spans`` are the bucket lengths wanted, the first that of ``time`` in the selected elems; with more
than one, rows have a ``span`` too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.functions import family
from routelens.operators import (
    LEVEL_KEYS,
    climb_levels,
    community_prefix_facts,
    contested_prefixes,
    label_levels,
    origin_facts,
    transit_facts,
    with_longer_spans,
)
from routelens.operators.origins import origin_number
from routelens.schema import COLLECTOR_KEYS, PEER_KEYS, TIME_KEYS

# The keys that tell rows apart come first, which halves the time where arrays are gathered by a sort.
_ORDER = ("prefix", "peer_address", "peer_asn", "collector", "project", "time")
_LEVELS = [[key for key in _ORDER if key == "prefix" or key in keys]
           for keys in (PEER_KEYS, COLLECTOR_KEYS, TIME_KEYS)]


def _by_level(facts: DataFrame, origins: Column) -> DataFrame:
    return facts.groupingSets(_LEVELS, *_ORDER).agg(
        F.expr("int(grouping(peer_address) + grouping(collector)) AS level"), origins.alias("origins"))


def _prefix_facts(selected: DataFrame, spans: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    facts = with_longer_spans(origin_facts(selected), spans).where("prefix IS NOT NULL")
    return facts, contested_prefixes(facts)


def _several_origins(facts: DataFrame, contested: DataFrame) -> DataFrame:
    """Of the contested prefixes, at each level, their sorted origins.

    An array holds each origin AS of one prefix once, so it is bounded by the number of ASes. Only
    facts of these prefixes are gathered; no hint is given, so they are broadcast only if few.
    """
    return _by_level(facts.join(contested, ["time", "prefix"], "left_semi"), F.sort_array(F.collect_set("origin")))


def prefix_origins(selected: DataFrame, spans: Sequence[int] = ()) -> DataFrame:
    """Every prefix with its origins, none to many."""
    facts, contested = _prefix_facts(selected, spans)
    # Elsewhere the origin is a number, the same at all levels that know one: a hash aggregate does.
    number = F.max(origin_number(F.col("origin"))).cast("string")
    plain = _by_level(facts.join(contested, ["time", "prefix"], "left_anti"),
                      F.array_compact(F.array(number)))
    rows = plain.unionByName(_several_origins(facts, contested))
    return label_levels(rows, family(F.col("prefix")).alias("family"), "prefix", "origins")


def moas_detail(selected: DataFrame, spans: Sequence[int] = ()) -> DataFrame:
    """The prefixes with more than one origin."""
    rows = _several_origins(*_prefix_facts(selected, spans)).where(F.size("origins") > 1)
    return label_levels(rows, family(F.col("prefix")).alias("family"), "prefix", "origins")


def transit_by_level(selected: DataFrame, spans: Sequence[int] = ()) -> DataFrame:
    """Level keys, family, transit AS and its number of prefixes.

    The row with a NULL transit AS has the number of all prefixes, and in ``via``
    that of prefixes with any transit AS.
    """
    counts = ("pfxs", "via")
    facts = with_longer_spans(transit_facts(selected), spans, counts)
    rows = climb_levels(facts, ["family", "transit"], ["prefix"], counts)
    return rows.groupBy(*LEVEL_KEYS, "family", "transit").agg(
        *[F.sum(name).alias(name) for name in counts])


def transit_detail(selected: DataFrame, spans: Sequence[int] = ()) -> DataFrame:
    rows = transit_by_level(selected, spans).where(F.col("transit").isNotNull())
    return label_levels(rows, "family", F.col("transit").alias("transit_asn"),
                        F.col("pfxs").alias("pfx_cnt"))


def community_detail(selected: DataFrame, spans: Sequence[int] = ()) -> DataFrame:
    by = ["family", "asn", "value"]
    facts = with_longer_spans(community_prefix_facts(selected), spans, ["pfxs"])
    rows = climb_levels(facts, by, ["prefix"], ["pfxs"])
    counted = rows.groupBy(*LEVEL_KEYS, *by).agg(F.sum("pfxs").alias("pfx_cnt"))
    return label_levels(counted, *by, "pfx_cnt")


DETAILS = {
    "prefix_origins": prefix_origins,
    "moas_detail": moas_detail,
    "transit_detail": transit_detail,
    "community_detail": community_detail,
}
