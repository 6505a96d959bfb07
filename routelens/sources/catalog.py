"""The collector catalogue: which project runs which collector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.schema import COLLECTORS_FILE, PROJECTS


def read_collectors(spark: SparkSession, path: str) -> DataFrame:
    """Read ``{"data": {"collectors": {name: {"project": ...}}}}`` as (collector, project).

    A document that is cut off, or has no such collectors, is an error.
    """
    document = spark.read.schema(COLLECTORS_FILE).json(path, multiLine=True, mode="FAILFAST")
    if document.where("data.collectors IS NOT NULL").isEmpty():
        raise ValueError(f"{path} has no data.collectors")
    return (
        document.select(F.explode("data.collectors").alias("collector", "details"))
        .select("collector", F.col("details.project").alias("project"))
    )


def in_projects(project: Column) -> Column:
    return project.isin(*PROJECTS)


def default_collectors(catalog: DataFrame) -> DataFrame:
    """Names of the collectors a report covers when none is asked for."""
    return catalog.where(in_projects(F.col("project"))).select("collector").distinct()
