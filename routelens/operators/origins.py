"""Origin sets of prefixes, counted without gathering them.

A set of origin ASes is told apart from others by what a hash aggregate can hold in fixed room: its
size, its smallest and largest AS number, and the exclusive or of its members' 64-bit hashes. Of one or
two AS numbers these alone decide. Two larger sets that are equal in size and at both ends would be
taken for one with a chance of 2**-64. The tables of origins hold the sets themselves.

Facts are climbed level by level (see :mod:`routelens.operators.levels`). As soon as a level is
counted, its prefixes are given up and only the sets stay, with the number of their prefixes, so that
the next step's partial aggregation merges them inside each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.functions import family
from routelens.operators.levels import LEVEL_KEYS, climb
from routelens.schema import COLLECTOR, COLLECTOR_KEYS, EVERYTHING, PEER, TIME_KEYS

#: What tells the sets of several origins apart, and how each comes from an origin or several.
MARKS = {
    "lowest": ("min", "if(string(try_cast(origin AS bigint)) = origin, try_cast(origin AS bigint), NULL)"),
    "highest": ("max", "if(string(try_cast(origin AS bigint)) = origin, try_cast(origin AS bigint), NULL)"),
    "hash": ("bit_xor", "if(origin IS NULL, NULL, xxhash64(origin))"),
}
_SET = ("kind", *[f"set_{mark}" for mark in MARKS])


def origin_number(origin: Column) -> Column:
    """The AS number of an origin that is one in plain digits, else NULL."""
    number = origin.try_cast("bigint")
    return F.when(number.cast("string") == origin, number)


def origin_sets_by_level(facts: DataFrame) -> DataFrame:
    """Level keys, ``family``, ``kind`` and ``pfxs``, one row per level and set of origins.

    ``facts`` are distinct (peer keys, prefix, origin), see
    :func:`routelens.operators.origin_facts`. ``kind`` is 0, 1 or 2 for no known origin, one, and
    several; prefixes of no or one origin share a row. ``pfxs`` is the number of prefixes.
    """
    rows = facts.select(
        *[key for key in LEVEL_KEYS if key != "level"], F.lit(PEER).alias("level"),
        family(F.col("prefix")).alias("family"), "prefix", "origin",
        F.expr("int(origin IS NOT NULL) AS origins"),
        *[F.expr(f"{of_origin} AS {mark}") for mark, (_, of_origin) in MARKS.items()],
        F.expr("cast(NULL AS bigint) AS kind"),
        *[F.expr(f"cast(NULL AS bigint) AS set_{mark}") for mark in MARKS],
        F.expr("0L AS pfxs"),
    )
    by = ("family", "prefix", *_SET)
    for level, upper_keys in ((PEER, COLLECTOR_KEYS), (COLLECTOR, TIME_KEYS)):
        rows = climb(rows, level, upper_keys, by, ["origin"], ["origins"], ["pfxs"], MARKS)
        rows = _counted(rows, level)
    rows = rows.groupBy(*LEVEL_KEYS, *by).agg(
        F.sum("origins").alias("origins"), F.sum("pfxs").alias("pfxs"),
        *[F.expr(f"{merge}({mark}) AS {mark}") for mark, (merge, _) in MARKS.items()])
    rows = _counted(rows.withColumn("origin", F.lit(None).cast("string")), EVERYTHING)
    return rows.groupBy(*LEVEL_KEYS, "family", *_SET).agg(F.sum("pfxs").alias("pfxs"))


def _counted(rows: DataFrame, level: int) -> DataFrame:
    """Give up the prefixes of ``level``, whose origins are all in one row now; keep their sets."""
    new = f"level = {level} AND kind IS NULL"
    return rows.select(
        *LEVEL_KEYS, "family",
        F.expr(f"if({new}, NULL, prefix) AS prefix"), "origin",
        F.expr(f"if({new}, NULL, origins) AS origins"),
        *[F.expr(f"if({new}, NULL, {mark}) AS {mark}") for mark in MARKS],
        F.expr(f"if({new}, least(origins, 2L), kind) AS kind"),
        *[F.expr(f"if({new}, if(origins > 1, {mark}, NULL), set_{mark}) AS set_{mark}")
          for mark in MARKS],
        F.expr(f"if({new}, bigint(prefix IS NOT NULL), pfxs) AS pfxs"),
    )


def contested_prefixes(facts: DataFrame) -> DataFrame:
    """(time, prefix) of prefixes with several origins over all collectors, or one that is no number.

    A prefix with one origin over everything has no more at any level, so only these need an array.
    """
    number = origin_number(F.col("origin"))
    found = facts.where("prefix IS NOT NULL").groupBy("time", "prefix").agg(
        F.min(number).alias("lowest"), F.max(number).alias("highest"),
        F.max(F.col("origin").isNotNull() & number.isNull()).alias("is_text"))
    return found.where("lowest < highest OR is_text").select("time", "prefix")
