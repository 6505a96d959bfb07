"""Running reports and detail tables from elems to files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.operators import check_spans, distinct_elems, select_elems, time_bounds
from routelens.plans import DETAILS, REPORTS, to_legacy_layout
from routelens.schema import ALL_COLLECTORS, ALL_PEERS, DAY_SECONDS, ELEMS
from routelens.sources.account import ReadAccount
from routelens.sources.scratch import ScratchTables


#: An empty prefix is not a missing one.
_CSV = {"header": True, "nullValue": "\\N"}


def _point(epoch: int, is_day: bool) -> str:
    return datetime.fromtimestamp(epoch, timezone.utc).strftime("%Y-%m-%d" if is_day else "%Y-%m-%dT%H%M%S")


def _marks(collector: str | None, legacy: bool, spans: Sequence[int]) -> str:
    lengths = "-".join(f"{span}s" for span in spans)
    return f".{lengths}" * (tuple(spans) != (DAY_SECONDS,)) + f".{collector}" * (
        collector is not None) + ".legacy" * legacy


def report_path(outdir: str, kind: str, data_type: str, start: int, end: int,
                prefix: str = "bgp", collector: str | None = None, legacy: bool = False,
                granularity: int = DAY_SECONDS, longer: Sequence[int] = ()) -> str:
    """``<outdir>/<prefix>-<kind>.<type>.<first day>-<end day>.csv``, a directory.

    Buckets other than days, a named collector and the older layout stand before the ending.
    """
    spans = (granularity, *longer)
    bounds = time_bounds(start, end, spans[-1])
    are_days = not any(bound % DAY_SECONDS for bound in bounds)
    days = "-".join(_point(bound, are_days) for bound in bounds)
    name = kind.replace("_", "")
    return f"{outdir.rstrip('/')}/{prefix}-{name}.{data_type}.{days}{_marks(collector, legacy, spans)}.csv"


def _check_kind(kind: str, kinds: Iterable[str] = REPORTS) -> None:
    if kind not in kinds:
        raise ValueError(f"kind must be one of {sorted(kinds)}, not {kind!r}")


def _select(elems: DataFrame, start: int, end: int, data_type: str, collector: str | None,
            catalog: DataFrame | None, granularity: int, longer: Sequence[int]) -> DataFrame:
    check_spans((granularity, *longer))
    return select_elems(elems, start, end, data_type, collector, catalog, granularity,
                        (granularity, *longer)[-1])


def build_report(kind: str, elems: DataFrame, start: int, end: int, data_type: str,
                 collector: str | None = None, catalog: DataFrame | None = None,
                 legacy: bool = False, granularity: int = DAY_SECONDS,
                 longer: Sequence[int] = ()) -> DataFrame:
    """The report as a DataFrame. ``legacy`` gives the older titles and counting rules.

    Rows are per bucket of ``granularity`` seconds. With ``longer`` bucket lengths, each a multiple of
    the one before, there are rows of those too, and a column ``span`` tells them apart.
    """
    _check_kind(kind)
    selected = _select(elems, start, end, data_type, collector, catalog, granularity, longer)
    report = REPORTS[kind](selected, (granularity, *longer))
    return to_legacy_layout(report, kind) if legacy else report


def build_details(kind: str, elems: DataFrame, start: int, end: int, data_type: str,
                  collector: str | None = None, catalog: DataFrame | None = None,
                  granularity: int = DAY_SECONDS, longer: Sequence[int] = ()) -> DataFrame:
    """The table behind a report (see ``routelens.plans.DETAILS``) as a DataFrame."""
    _check_kind(kind, DETAILS)
    selected = _select(elems, start, end, data_type, collector, catalog, granularity, longer)
    return DETAILS[kind](selected, (granularity, *longer))


def _ordered(report: DataFrame) -> DataFrame:
    """Peer rows, then collector rows, then rows over everything."""
    columns = {name.lower(): F.col(f"`{name}`") for name in report.columns[:4]}
    keys = [columns[name] for name in ("time", "span", "collector", "peer") if name in columns]
    return report.orderBy(columns["collector"] == ALL_COLLECTORS, columns["peer"] == ALL_PEERS, *keys)


def write_report(report: DataFrame, path: str, format: str = "csv",
                 overwrite: bool = False) -> None:
    """Write peer rows, then collector rows, then day rows. Fails if the path exists.

    The order is a distributed sort, so a long report is written by many tasks
    and its files follow each other in order. Adaptive execution gives a short
    one a single file.
    """
    writer = _ordered(report).write.mode("overwrite" if overwrite else "errorifexists").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def _named(path: str, format: str) -> str:
    return path if format == "csv" else f"{path.removesuffix('.csv')}.{format}"


def run_report(kind: str, elems: DataFrame, start: int, end: int, data_type: str, outdir: str,
               collector: str | None = None, catalog: DataFrame | None = None,
               legacy: bool = False, format: str = "csv", prefix: str = "bgp",
               overwrite: bool = False, granularity: int = DAY_SECONDS,
               longer: Sequence[int] = (), account: ReadAccount | None = None,
               workdir: str | None = None) -> str:
    """Build one report and write it under ``outdir``. Returns the path written.

    ``start`` and ``end`` are epoch seconds, rounded out to whole UTC days, or to the longest bucket. An
    existing report at the same path is replaced only with ``overwrite``.

    With the ``account`` that ``read_elems_with_account`` gave with the elems, the pass over them counts
    what was read, selected and rejected, and nothing is written if too many rows were rejected. The
    report waits for that in a table under ``workdir``, or ``spark.checkpoint.dir``.
    """
    _check_kind(kind)
    selected = _select(elems, start, end, data_type, collector, catalog, granularity, longer)
    selected = account.of_selection(selected) if account else selected
    report = REPORTS[kind](selected, (granularity, *longer))
    report = to_legacy_layout(report, kind) if legacy else report
    path = _named(report_path(outdir, kind, data_type, start, end, prefix, collector, legacy,
                              granularity, longer), format)
    if account is None:
        write_report(report, path, format, overwrite)
        return path
    with ScratchTables(elems.sparkSession, workdir) as scratch:
        stored = scratch.write(report)
        account.check()
        write_report(stored, path, format, overwrite)
    return path


def run_reports(kinds: Iterable[str], elems: DataFrame, start: int, end: int, data_type: str,
                outdir: str, collector: str | None = None, catalog: DataFrame | None = None,
                format: str = "csv", prefix: str = "bgp", workdir: str | None = None,
                legacy: bool = False, overwrite: bool = False, granularity: int = DAY_SECONDS,
                longer: Sequence[int] = ()) -> dict[str, str]:
    """Write several reports with one pass over paths and communities.

    The distinct statements are written out once and the reports made from them;
    only the element counts go back to the elems, of which they read few columns.
    The table goes under ``workdir``, or without one under ``spark.checkpoint.dir``, and is dropped
    at the end, also after an error.
    """
    kinds = list(kinds)
    for kind in kinds:
        _check_kind(kind)
        if legacy and kind == "elem_counts":
            raise ValueError("elem_counts has no legacy layout")
    spans = (granularity, *longer)
    selected = _select(elems, start, end, data_type, collector, catalog, granularity, longer)
    paths = {}

    def write(kind: str, rows: DataFrame) -> None:
        report = REPORTS[kind](rows, spans)
        report = to_legacy_layout(report, kind) if legacy else report
        paths[kind] = _named(report_path(outdir, kind, data_type, start, end, prefix, collector, legacy,
                                         granularity, longer), format)
        write_report(report, paths[kind], format, overwrite)

    if "elem_counts" in kinds:
        write("elem_counts", selected)
    sharing = [kind for kind in kinds if kind != "elem_counts"]
    if sharing:
        with ScratchTables(elems.sparkSession, workdir) as scratch:
            statements = scratch.write(distinct_elems(selected))
            for kind in sharing:
                write(kind, statements)
    return paths


def _read(spark: SparkSession, path: str, format: str) -> DataFrame | None:
    """What is at a path, None if there is nothing."""
    try:
        return spark.read.format(format).option("header", True).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def update_report(kind: str, elems: DataFrame, start: int, end: int, data_type: str, outdir: str,
                  collector: str | None = None, catalog: DataFrame | None = None,
                  format: str = "parquet", prefix: str = "bgp", replace: bool = False,
                  granularity: int = DAY_SECONDS) -> str:
    """Bring a growing report, with a directory for each bucket, up to date. Returns its path.

    Buckets of the interval that the report does not have yet are added; elems of those that it has are
    left out before anything is counted. With ``replace`` all buckets of the interval are made anew, and
    exactly their directories replaced. A bucket that has no more elems keeps what it had.
    """
    _check_kind(kind)
    path = (f"{outdir.rstrip('/')}/{prefix}-{kind.replace('_', '')}.{data_type}"
            f"{_marks(collector, False, (granularity,))}.{format}")
    selected = _select(elems, start, end, data_type, collector, catalog, granularity, ())
    there = None if replace else _read(elems.sparkSession, path, format)
    if there is not None:
        # One row for each bucket; the planner broadcasts it as long as that is small.
        done = there.select(F.col("time").cast("long").alias("time")).distinct()
        selected = selected.join(done, "time", "left_anti")
    report = REPORTS[kind](selected).hint("rebalance", "time").sortWithinPartitions(
        "time", F.col("collector") == ALL_COLLECTORS, F.col("peer") == ALL_PEERS, "collector", "peer")
    writer = report.write.format(format).partitionBy("time").option("header", True)
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)
    else:
        writer.mode("append").save(path)
    return path


def read_report(spark: SparkSession, kind: str, path: str, format: str = "parquet") -> DataFrame:
    """A report written by :func:`update_report`, with its columns in order and of their types."""
    like = REPORTS[kind](select_elems(spark.createDataFrame([], ELEMS), 0, 0, "updates"))
    return spark.read.schema(like.schema).format(format).option("header", True).load(path).select(*like.columns)


def run_details(kind: str, elems: DataFrame, start: int, end: int, data_type: str, outdir: str,
                collector: str | None = None, catalog: DataFrame | None = None, format: str = "csv",
                prefix: str = "bgp", overwrite: bool = False, granularity: int = DAY_SECONDS,
                longer: Sequence[int] = ()) -> str:
    """Write the table behind a report under ``outdir``. Returns the path written.

    There is a directory for each bucket and family, so a reader of one day's IPv6 opens only that;
    within, rows are sorted by collector, peer and the rest. Arrays become text in CSV, their items
    joined by blanks. Adaptive execution splits a directory that is too large for one task.
    """
    table = build_details(kind, elems, start, end, data_type, collector, catalog, granularity, longer)
    path = _named(report_path(outdir, kind, data_type, start, end, prefix, collector, False,
                              granularity, longer), format)
    by = [name for name in ("span", "time", "family") if name in table.columns]
    order = [name for name, kind_ in table.dtypes if name not in by and not kind_.startswith("array")]
    if format == "csv":
        table = table.select(*[F.array_join(name, " ").alias(name) if kind_.startswith("array") else name
                               for name, kind_ in table.dtypes])
    (table.hint("rebalance", *by).sortWithinPartitions(*by, *order)
     .write.mode("overwrite" if overwrite else "errorifexists").format(format)
     .options(**_CSV).partitionBy(*by).save(path))
    return path


def read_details(spark: SparkSession, kind: str, path: str, format: str = "csv") -> DataFrame:
    """A table written by :func:`run_details`: its columns in order, of their types, arrays as arrays."""
    _check_kind(kind, DETAILS)
    empty = select_elems(spark.createDataFrame([], ELEMS), 0, 0, "updates")
    there = _read(spark, path, format)
    spans = (1, 2) if there is not None and "span" in there.columns else ()
    like = DETAILS[kind](empty, spans).dtypes
    if format == "csv":
        stored = ", ".join(f"`{n}` {'string' if t.startswith('array') else t}" for n, t in like)
        rows = spark.read.schema(stored).format(format).options(**_CSV).load(path)
        return rows.select(*[
            F.expr(f"if(coalesce(`{n}`, '') = '', array(), split(`{n}`, ' '))").cast(t).alias(n)
            if t.startswith("array") else n for n, t in like])
    stored = ", ".join(f"`{n}` {t}" for n, t in like)
    return spark.read.schema(stored).format(format).load(path).select(*[n for n, _ in like])
