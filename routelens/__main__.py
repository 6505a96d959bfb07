"""``python -m routelens`` or ``spark-submit``: reports from elems to files."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from routelens.job import run_details, run_report, run_reports, update_report
from routelens.operators import time_bounds
from routelens.plans import DETAILS, REPORTS, elem_fields
from routelens.schema import DAY_SECONDS, RECORD_TYPES
from routelens.sources import read_collectors, read_elems, read_elems_with_account


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="routelens", description=__doc__)
    parser.add_argument("kinds", nargs="+", choices=sorted([*REPORTS, *DETAILS]))
    parser.add_argument("--start", type=int, required=True, help="epoch seconds")
    parser.add_argument("--end", type=int, required=True, help="epoch seconds, exclusive")
    parser.add_argument("--type", choices=RECORD_TYPES, required=True, dest="data_type")
    parser.add_argument("--input", required=True, help="elems table")
    parser.add_argument("--input-format", default="parquet")
    parser.add_argument("--nested", action="store_true", help="records that hold elems")
    parser.add_argument("--outdir", required=True)
    parser.add_argument("--collector")
    parser.add_argument("--catalog", help="collectors document")
    parser.add_argument("--format", default="csv")
    parser.add_argument("--legacy", action="store_true")
    parser.add_argument("--overwrite", action="store_true")
    parser.add_argument("--granularity", type=int, default=DAY_SECONDS, help="seconds of a bucket")
    parser.add_argument("--longer", type=int, nargs="*", default=(), help="seconds of longer buckets")
    parser.add_argument("--update", action="store_true",
                        help="add the buckets that a growing report lacks")
    parser.add_argument("--replace", action="store_true",
                        help="with --update, make the buckets of the interval anew")
    parser.add_argument("--most-rejected", type=int,
                        help="count rows, and fail if more than so many cannot be made out")
    parser.add_argument("--workdir", help="shared folder, if spark.checkpoint.dir names none")
    return parser


def main(arguments: Sequence[str] | None = None) -> list[str]:
    """Write the reports and tables asked for and return their paths.

    With ``--most-rejected`` the counts of each pass are printed.
    """
    given = _parser().parse_args(arguments)
    spark = SparkSession.builder.appName("routelens").getOrCreate()
    options = {"collector": given.collector, "format": given.format, "granularity": given.granularity,
               "catalog": read_collectors(spark, given.catalog) if given.catalog else None}
    span = (given.start, given.end, given.data_type, given.outdir)
    reports = [kind for kind in given.kinds if kind in REPORTS]
    paths = {}
    if given.most_rejected is not None:
        longest = max(DAY_SECONDS, given.granularity, *given.longer)
        first, last = time_bounds(given.start, given.end, longest)
        for kind in reports:
            elems, account = read_elems_with_account(spark, given.input, given.input_format, given.nested,
                                                     given.most_rejected, first, last)
            paths[kind] = run_report(kind, elems, *span, **options, legacy=given.legacy,
                                     overwrite=given.overwrite, longer=given.longer, account=account,
                                     workdir=given.workdir)
            print(kind, account.counts())
        reports = []
    elems = read_elems(spark, given.input, given.input_format, given.nested, elem_fields(given.kinds))
    if given.update:
        for kind in reports:
            paths[kind] = update_report(kind, elems, *span, **options, replace=given.replace)
        reports = []
    more = {**options, "longer": given.longer, "overwrite": given.overwrite}
    if len(reports) == 1:
        paths[reports[0]] = run_report(reports[0], elems, *span, **more, legacy=given.legacy)
    elif reports:
        paths |= run_reports(reports, elems, *span, **more, legacy=given.legacy, workdir=given.workdir)
    for kind in given.kinds:
        if kind in DETAILS:
            paths[kind] = run_details(kind, elems, *span, **more)
    return [paths[kind] for kind in dict.fromkeys(given.kinds)]


if __name__ == "__main__":
    for path in main():
        print(path)
