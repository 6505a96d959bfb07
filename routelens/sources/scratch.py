"""Tables that a run needs only for itself, in the cluster's shared folder."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """The folder given, else the one that ``spark.checkpoint.dir`` names. Without either an error."""
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir, or give a shared workdir")
    return folder.rstrip("/")


class ScratchTables:
    """Parquet tables in a database of their own, dropped by SQL when the block ends, also by an error.

    Unlike a cache they outlive lost executors, and each reader takes only the columns it needs.
    Only SQL and the public reader and writer are used, so this works through Spark Connect too.

    The database lies under the shared folder. Give ``folder`` where that is not the one
    ``spark.checkpoint.dir`` names.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self._spark = spark
        self.database = f"routelens_{uuid4().hex}"
        self.location = f"{shared_folder(spark, folder)}/{self.database}"
        self._number = 0

    def __enter__(self) -> ScratchTables:
        place = self.location.replace("\\", "\\\\").replace("'", "\\'")
        self._spark.sql(f"CREATE DATABASE {self.database} LOCATION '{place}'")
        return self

    def __exit__(self, *error: object) -> None:
        self._spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")

    def write(self, rows: DataFrame) -> DataFrame:
        """The rows as a table: computed once, and their lineage ends there."""
        self._number += 1
        name = self._name(self._number)
        rows.write.format("parquet").saveAsTable(name)
        return self._spark.table(name)

    def drop_all_but(self, last: int) -> None:
        """Drop all tables but the ``last`` ones written, before the block ends."""
        for number in range(1, self._number - last + 1):
            self._spark.sql(f"DROP TABLE IF EXISTS {self._name(number)}")

    def _name(self, number: int) -> str:
        return f"{self.database}.rows{number}"
