from routelens.functions.keys import bucket_floor, day_floor, family, peer_label
from routelens.functions.paths import (
    hops,
    interior,
    is_valid_origin,
    origin,
    squash,
    tokens,
)

__all__ = [
    "bucket_floor", "day_floor", "family", "hops", "interior", "is_valid_origin", "origin",
    "peer_label", "squash", "tokens",
]
