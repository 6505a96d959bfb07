"""Time as one more level: hours are merged to days as peers are to collectors.

Distinct counts of hours do not add up to those of a day, but the facts that are distinct per hour and
peer merge to those of the day and peer. So the hours' facts are made once, and one ``GROUPING SETS``
keeps them and merges them per longer period. From there on a time is a bucket, (span, start), and
every level of every span is climbed together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from routelens.functions import bucket_floor


def check_spans(spans: Sequence[int]) -> None:
    """Each span must be a positive multiple of the one before it."""
    if not spans or any(span <= 0 for span in spans):
        raise ValueError(f"spans must be positive, not {tuple(spans)}")
    for shorter, longer in zip(spans, spans[1:], strict=False):
        if longer <= shorter or longer % shorter:
            raise ValueError(f"a span must be a multiple of the one before it, not {tuple(spans)}")


def with_longer_spans(facts: DataFrame, spans: Sequence[int], counts: Sequence[str] = (),
                      sums: Sequence[str] = ()) -> DataFrame:
    """Facts per bucket of each span, from facts per bucket of the first.

    ``facts`` are distinct over all columns but ``counts``, 0/1 columns of which a merged fact has
    the largest, and ``sums``, which add up. ``time`` becomes (span, start). With one span, or none,
    the facts are returned as they are.
    """
    if len(spans) < 2:
        return facts
    check_spans(spans)
    names = [name for name in facts.columns if name != "time"]
    items = [name for name in names if name not in (*counts, *sums)]
    buckets = [f"__span{span}" for span in spans]
    cut = facts.select(*[
        F.struct(F.lit(span).alias("span"), bucket_floor(F.col("time"), span).alias("start")).alias(bucket)
        for span, bucket in zip(spans, buckets, strict=True)], *names)
    merged = cut.groupingSets([[bucket, *items] for bucket in buckets], *buckets, *items).agg(
        F.grouping(buckets[0]).alias("__merged"), *[F.max(name).alias(name) for name in counts], *[F.sum(name).alias(name) for name in sums])
    return merged.select(F.coalesce(*buckets).alias("time"), *names)


def time_columns(rows: DataFrame) -> list:
    """``time``, and where rows are of several spans also ``span``, in seconds."""
    if isinstance(rows.schema["time"].dataType, StructType):
        return [F.col("time.start").alias("time"), F.col("time.span").alias("span")]
    return [F.col("time")]
