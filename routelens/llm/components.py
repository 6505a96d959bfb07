"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import written


def _star(links: DataFrame) -> DataFrame:
    """Per node the smallest of itself and its neighbours; ``links`` holds node and neighbour.

    Only minima are aggregated, so a node with many neighbours is combined in
    each task before the shuffle and never gathered.
    """
    return links.groupBy("node").agg(F.least("node", F.min("other")).alias("least"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(
        edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    joined = both.join(_star(both), "node").where(F.col("other") > F.col("node"))
    return joined.select(F.col("other").alias("src"), F.col("least").alias("dst"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("node"), F.least("src", "dst").alias("other"))
    joined = down.join(_star(down), "node")
    return joined.select(
        F.when(F.col("other") == F.col("least"), F.col("node")).otherwise(F.col("other"))
        .alias("src"), F.col("least").alias("dst"))


def _sum(edges: DataFrame) -> tuple:
    """Rows and an order-free checksum."""
    return tuple(edges.agg(F.count("*"), F.sum(
        F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst; longs), component the smallest node.

    Self-links and repeated links do no harm; no links give no rows. Each round is
    written to the shared folder, and the rounds number about the logarithm of the
    longest path. The driver sees two numbers a round.
    """
    edges = written(edges.where("src <> dst").select("src", "dst").distinct())
    before = _sum(edges)
    while before[0]:
        edges = written(_small(_large(edges).distinct()).where("src <> dst").distinct())
        now = _sum(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("dst").alias("node")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
