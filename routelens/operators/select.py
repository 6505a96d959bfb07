"""Choosing the elems a report covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.functions import bucket_floor
from routelens.schema import DAY_SECONDS, LAYOUT_DAY, RECORD_TYPES
from routelens.sources.catalog import default_collectors, in_projects


def time_bounds(start: int, end: int, span: int = DAY_SECONDS) -> tuple[int, int]:
    """Round the start down and the end up to whole buckets of ``span`` seconds, by default UTC days."""
    return start // span * span, -(-end // span) * span


def day_bounds(start: int, end: int) -> tuple[int, int]:
    return time_bounds(start, end)


def select_elems(elems: DataFrame, start: int, end: int, data_type: str,
                 collector: str | None = None, catalog: DataFrame | None = None,
                 granularity: int = DAY_SECONDS, longest: int | None = None) -> DataFrame:
    """Elems of one record type in ``[start, end)``, with their bucket in ``time``.

    Buckets are ``granularity`` seconds long and start at multiples of that; the bounds are rounded
    out to whole buckets, or to those of ``longest`` seconds. A named collector is taken whatever its project. Otherwise the collectors
    of the covered projects are taken: those the catalogue lists, or without a
    catalogue those whose rows name such a project.
    """
    if data_type not in RECORD_TYPES:
        raise ValueError(f"data_type must be one of {RECORD_TYPES}, not {data_type!r}")
    if granularity <= 0:
        raise ValueError(f"granularity must be positive, not {granularity}")
    first, last = time_bounds(start, end, longest or granularity)
    rows = elems.where(
        (F.col("record_type") == data_type)
        & (F.col("record_time") >= first) & (F.col("record_time") < last)
    )
    if LAYOUT_DAY in elems.columns:  # directory column: skips files, drops no row
        rows = rows.where((F.col(LAYOUT_DAY) >= time_bounds(first, last)[0]) & (F.col(LAYOUT_DAY) < last))
    if collector is not None:
        rows = rows.where(F.col("collector") == collector)
    elif catalog is not None:
        # No hint: the planner broadcasts the catalogue only if it is small.
        rows = rows.join(default_collectors(catalog), "collector", "left_semi")
    else:
        rows = rows.where(in_projects(F.col("project")))
    return rows.withColumn("time", bucket_floor(F.col("record_time"), granularity))
