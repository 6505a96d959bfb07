"""Reading and laying out the elems table."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.functions import day_floor
from routelens.schema import ELEM, ELEMS, LAYOUT_DAY, NESTED_RECORDS

_LAYOUT = (LAYOUT_DAY, "record_type", "collector")
_OPTIONAL = {"elem_type"}
_MODES = {"fail": "errorifexists", "append": "append", "replace": "overwrite"}


def read_elems(spark: SparkSession, path: str, format: str = "parquet",
               nested: bool = False, fields: Collection[str] | None = None) -> DataFrame:
    """Read elems with a declared schema, so no pass over the data infers one.

    A table laid out by :func:`write_elems` keeps its directory column, which
    :func:`routelens.operators.select_elems` prunes by. With ``nested``, the rows are
    records holding an ``elems`` array, of which only ``fields`` are opened (see ``flatten_records``).

    A file format with columns of its own must have all of the schema's but ``elem_type``.
    In JSON a missing field is NULL, and a line that is cut off or holds a wrong type ends
    the job when a field that the job reads cannot be made out.
    """
    rows = read_rows(spark, path, format, nested)
    return flatten_records(rows, fields) if nested else rows


def read_rows(spark: SparkSession, path: str, format: str, nested: bool) -> DataFrame:
    """Elems, or with ``nested`` records, as they are stored."""
    schema = NESTED_RECORDS if nested else ELEMS
    if format not in ("json", "csv", "text"):
        there = spark.read.format(format).load(path).columns
        missing = [name for name in schema.fieldNames() if name not in there and name not in _OPTIONAL]
        if missing:
            raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return spark.read.schema(schema).format(format).option("mode", "FAILFAST").load(path)


def flatten_records(records: DataFrame, fields: Collection[str] | None = None) -> DataFrame:
    """One row per elem. A record without elems yields no row.

    The planner prunes fields through an explode only if a single one is wanted. With ``fields``
    given, for example ``routelens.plans.elem_fields(kinds)``, the arrays of just these are zipped, so
    that a columnar file is read in these alone; the other columns are NULL.
    """
    outer = [name for name in records.columns if name != "elems"]
    wanted = [field.name for field in ELEM.fields if fields is None or field.name in fields]
    if fields is None or not wanted:
        items = F.col("elems")
    else:
        items = F.arrays_zip(*[F.col(f"elems.{name}").alias(name) for name in wanted])
    return (
        records.select(*outer, F.explode(items).alias("elem"))
        .select(*outer, *[F.col(f"elem.{field.name}") if field.name in wanted
                          else F.lit(None).cast(field.dataType).alias(field.name) for field in ELEM.fields])
    )


def write_elems(elems: DataFrame, path: str, mode: str = "fail") -> None:
    """Write Parquet laid out by day, record type and collector.

    ``mode``: ``fail`` if the path exists; ``append``; or ``replace`` exactly the
    directories that the given rows belong to, leaving all others.

    The three source filters then skip whole directories. The rebalance hint
    groups rows by directory, so few small files arise, and adaptive execution
    splits a directory that is too large for one task.
    """
    if mode not in _MODES:
        raise ValueError(f"mode must be one of {sorted(_MODES)}, not {mode!r}")
    (
        elems.withColumn(LAYOUT_DAY, day_floor(F.col("record_time")))
        .hint("rebalance", *_LAYOUT)
        .write.mode(_MODES[mode]).option("partitionOverwriteMode", "dynamic")
        .partitionBy(*_LAYOUT).parquet(path)
    )
