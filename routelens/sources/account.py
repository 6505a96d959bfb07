"""Reading elems with an account of the rows read, selected and rejected.

The counts are metrics of the pass that makes a report, so the input is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from routelens.schema import ELEMS, LAYOUT_DAY, NESTED_RECORDS
from routelens.sources.elems import flatten_records, read_rows

_TEXT_FORMATS = ("json", "csv")
_BROKEN = "routelens_broken_row"


class RejectedRows(ValueError):
    """More rows could not be made out than the caller allows."""


class _Pass:
    """Metrics of a DataFrame, found while a report is made of it."""

    def __init__(self) -> None:
        self._observation = Observation()
        self._found: dict[str, int] | None = None

    def over(self, rows: DataFrame, *metrics: Column) -> DataFrame:
        self._rows, self._metrics = rows, metrics
        return rows.observe(self._observation, *metrics)

    def found(self) -> dict[str, int]:
        if self._found is None:
            try:
                self._found = self._observation.get
            except Exception:  # noqa: BLE001
                # Where no row is selected, adaptive execution drops the plan together with its
                # metrics, and asking for them fails. Only then the rows are counted once more.
                self._found = self._rows.agg(*self._metrics).first().asDict()
        return self._found


class ReadAccount:
    """What became of the rows of one read, known once a report of it has been made."""

    def __init__(self, most_rejected: int = 0):
        self.most_rejected = most_rejected
        self._input, self._selection = _Pass(), _Pass()

    def of_input(self, rows: DataFrame) -> DataFrame:
        """Rows as read; those with ``routelens_broken_row`` are counted as rejected and left out."""
        read = F.count("*").alias("read")
        if _BROKEN not in rows.columns:
            return self._input.over(rows, read, F.count_if(F.lit(False)).alias("rejected"))
        # A text row is only checked in the columns that are parsed. All are named here, so that the
        # same rows are rejected whatever the report reads.
        named = F.max(F.hash(*[F.col(name) for name in rows.columns])).alias("named")
        counted = self._input.over(rows, read, F.count(_BROKEN).alias("rejected"), named)
        return counted.where(F.col(_BROKEN).isNull()).drop(_BROKEN)

    def of_selection(self, rows: DataFrame) -> DataFrame:
        return self._selection.over(rows, F.count("*").alias("selected"))

    def counts(self) -> dict[str, int]:
        """``read``, ``selected`` and ``rejected``; waits for the pass that counts them.

        A read of records that hold elems counts records, its selection elems.
        """
        found = self._input.found()
        return {"read": found["read"], "selected": self._selection.found()["selected"],
                "rejected": found["rejected"]}

    def check(self) -> None:
        """An error if more rows were rejected than allowed."""
        rejected = self._input.found()["rejected"]
        if rejected > self.most_rejected:
            raise RejectedRows(f"{rejected} rows could not be made out; {self.most_rejected} are allowed")


def read_elems_with_account(spark: SparkSession, path: str, format: str = "parquet", nested: bool = False,
                            most_rejected: int = 0, start: int | None = None,
                            end: int | None = None) -> tuple[DataFrame, ReadAccount]:
    """Elems as :func:`routelens.sources.read_elems` gives them, and an account of them.

    Rows of JSON or CSV that cannot be made out are counted and left out; give the account to
    ``run_report``, which writes nothing if there are more than ``most_rejected``. Other formats have
    no such rows.

    Counting all rows means reading them: the filters of a report are not pushed below the count. Of a
    table laid out by ``write_elems``, days that lie outside ``start`` and ``end`` are not opened; give
    them rounded as the report rounds them (``routelens.operators.time_bounds``).
    """
    account = ReadAccount(most_rejected)
    if format in _TEXT_FORMATS:
        schema = NESTED_RECORDS if nested else ELEMS
        rows = (spark.read.schema(_with_broken(schema)).format(format)
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN).load(path))
    else:
        rows = read_rows(spark, path, format, nested)
    if LAYOUT_DAY in rows.columns:
        if start is not None:
            rows = rows.where(F.col(LAYOUT_DAY) > start - 86_400)
        if end is not None:
            rows = rows.where(F.col(LAYOUT_DAY) < end)
    rows = account.of_input(rows)
    return (flatten_records(rows) if nested else rows), account


def _with_broken(schema: StructType) -> StructType:
    """The schema and a column for the text of a row that cannot be made out."""
    return StructType([*schema.fields, StructField(_BROKEN, StringType())])
