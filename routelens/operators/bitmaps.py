"""Distinct whole numbers counted by bitmaps, which merge upward by OR.

A bitmap holds 32,768 numbers in 4 kB, whatever many of them there are. So this pays where numbers lie
close together, as those of records given one after the other, and is a waste where they are hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.operators.levels import LEVEL_KEYS
from routelens.schema import COLLECTOR, COLLECTOR_KEYS, EVERYTHING, PEER, PEER_KEYS


def record_bitmaps(selected: DataFrame) -> DataFrame:
    """Per vantage point and range of record ids: number of elems, and the bitmap of their records."""
    return selected.groupBy(*PEER_KEYS, F.bitmap_bucket_number("record_id").alias("range")).agg(
        F.count("*").alias("elem_cnt"),
        F.bitmap_construct_agg(F.bitmap_bit_position("record_id")).alias("records"))


def climb_record_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """Level keys, ``elem_cnt`` and ``record_cnt``.

    A record belongs to one collector, so above the collectors its counts add up.
    """
    ranges = [[*PEER_KEYS, "range"], [*COLLECTOR_KEYS, "range"]]
    counted = bitmaps.groupingSets(ranges, *PEER_KEYS, "range").agg(
        F.expr(f"if(grouping(peer_address) = 1, {COLLECTOR}, {PEER}) AS level"),
        F.sum("elem_cnt").alias("elem_cnt"),
        F.bitmap_count(F.bitmap_or_agg("records")).alias("record_cnt"))
    # The rows of a level, and those of all collectors once more for everything.
    own = F.struct(*PEER_KEYS, "level")
    all_of = F.struct("time", *[F.lit(None).cast("string").alias(key) for key in ("collector", "project")],
                      F.lit(None).cast("long").alias("peer_asn"),
                      F.lit(None).cast("string").alias("peer_address"), F.lit(EVERYTHING).alias("level"))
    rows = counted.select(F.explode(F.when(F.col("level") == COLLECTOR, F.array(own, all_of))
                                    .otherwise(F.array(own))).alias("at"), "elem_cnt", "record_cnt")
    return rows.select("at.*", "elem_cnt", "record_cnt").groupBy(*LEVEL_KEYS).agg(
        F.sum("elem_cnt").alias("elem_cnt"), F.sum("record_cnt").alias("record_cnt"))
