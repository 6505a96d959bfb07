"""Expressions for the grouping keys: day, address family, peer label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routelens.schema import DAY_SECONDS


def bucket_floor(epoch: Column, span: int) -> Column:
    """Start of the bucket of ``span`` seconds that an epoch-second column lies in, as bigint."""
    return epoch - F.pmod(epoch, F.lit(span))


def day_floor(epoch: Column) -> Column:
    """Start of the UTC day of an epoch-second column, as bigint."""
    return bucket_floor(epoch, DAY_SECONDS)


def family(prefix: Column) -> Column:
    """6 if the text holds a colon, else 4; NULL without a prefix."""
    return F.when(prefix.contains(":"), 6).when(prefix.isNotNull(), 4)


def peer_label(peer_asn: Column, peer_address: Column) -> Column:
    return F.concat(F.lit("AS"), peer_asn.cast("string"), F.lit("-"), peer_address)
