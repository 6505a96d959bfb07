from routelens.operators.bitmaps import climb_record_bitmaps, record_bitmaps
from routelens.operators.facts import (
    community_facts,
    community_prefix_facts,
    distinct_elems,
    origin_facts,
    record_facts,
    routing_facts,
    transit_facts,
)
from routelens.operators.levels import LEVEL_KEYS, climb, climb_levels, label_levels
from routelens.operators.origins import contested_prefixes, origin_sets_by_level
from routelens.operators.periods import check_spans, with_longer_spans
from routelens.operators.select import day_bounds, select_elems, time_bounds

__all__ = [
    "LEVEL_KEYS", "check_spans", "climb", "climb_levels", "climb_record_bitmaps",
    "community_facts",
    "community_prefix_facts", "contested_prefixes", "day_bounds", "distinct_elems", "label_levels",
    "origin_facts", "origin_sets_by_level", "record_bitmaps", "record_facts", "routing_facts", "select_elems",
    "time_bounds", "transit_facts", "with_longer_spans",
]
