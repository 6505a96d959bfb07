"""One query per operator and report, over elems derived from ``lineitem``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.edges import edges_of, records_of
from checks.lineitem import elems_from_lineitem
from routelens import functions as R
from routelens import plans
from routelens.operators import LEVEL_KEYS, climb, climb_levels, label_levels, select_elems
from routelens.schema import (
    COLLECTOR,
    COLLECTOR_KEYS,
    PEER,
    PEER_KEYS,
    TIME_KEYS,
)
from routelens.sources import flatten_records
from routelens.sources.catalog import default_collectors

FIRST_DAY = 1_451_606_400
THIRD_DAY = FIRST_DAY + 2 * 86_400
FOURTH_DAY = FIRST_DAY + 3 * 86_400

Query = Callable[[SparkSession, str], DataFrame]


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days of updates from the collectors of both projects."""
    return select_elems(elems_from_lineitem(spark, sf_dir), FIRST_DAY, THIRD_DAY, "updates")


def ribs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three days of RIB dumps."""
    return select_elems(elems_from_lineitem(spark, sf_dir), FIRST_DAY, FOURTH_DAY, "ribs")


def one_collector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of a collector that belongs to neither project."""
    return select_elems(elems_from_lineitem(spark, sf_dir), FIRST_DAY, FOURTH_DAY, "updates",
                        collector="other00")


def rounded(report: DataFrame) -> DataFrame:
    """Means and deviations to 6 places, as two engines differ in the last bits."""
    return report.select(*[
        F.round(F.col(f"`{name}`"), 6).alias(name) if kind == "double" else F.col(f"`{name}`")
        for name, kind in report.dtypes
    ])


def over(selection: Query, plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(plan(selection(spark, sf_dir)))


def selected_rows(selected: DataFrame) -> DataFrame:
    as_text = F.transform("communities", lambda c: F.concat(
        c["asn"].cast("string"), F.lit(":"), c["value"].cast("string")))
    return selected.withColumn("communities", F.array_join(as_text, " "))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of awkward rows. The bounds lie within the first and the second day."""
    return select_elems(edges_of(elems_from_lineitem(spark, sf_dir)), FIRST_DAY + 40_000,
                        FIRST_DAY + 86_401, "updates")


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days of updates, by the hour."""
    return select_elems(elems_from_lineitem(spark, sf_dir), FIRST_DAY, THIRD_DAY, "updates", granularity=3600)


def from_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days of updates whose elems come out of their records again."""
    flat = flatten_records(records_of(elems_from_lineitem(spark, sf_dir)),
                           plans.elem_fields(["elem_counts", "community"]))
    return select_elems(flat, FIRST_DAY, THIRD_DAY, "updates")


def hours_and_days(plan: Callable[..., DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda selected: plan(selected, (3600, 86_400))


def catalog_that_disagrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue that lacks one collector and gives two to other projects than their rows."""
    elems = elems_from_lineitem(spark, sf_dir)
    catalog = elems.select("collector").distinct().where("collector <> 'rrc01'").selectExpr(
        "collector", """CASE collector WHEN 'route-views2' THEN 'other' WHEN 'other00' THEN 'ris'
                        WHEN 'rrc00' THEN 'ris' ELSE 'routeviews' END AS project""")
    selected = select_elems(elems, FIRST_DAY, THIRD_DAY, "updates", catalog=catalog)
    return selected.groupBy("time", "project", "collector").agg(F.count("*").alias("elem_cnt"))


def edge_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("as_path")
    return (edges_of(elems_from_lineitem(spark, sf_dir)).select("as_path").distinct().where(path.isNotNull())
            .select(path, R.squash(path).alias("squashed"), R.origin(path).alias("origin"),
                    F.size(R.hops(path)).cast("long").alias("hop_cnt"),
                    F.size(R.tokens(path)).cast("long").alias("token_cnt")))


def catalog_of(elems: DataFrame) -> DataFrame:
    return elems.select("project", "collector").distinct()


def collectors_in_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = catalog_of(elems_from_lineitem(spark, sf_dir))
    return catalog.join(default_collectors(catalog), "collector", "left_semi")


def catalog_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    elems = elems_from_lineitem(spark, sf_dir)
    selected = select_elems(elems, FIRST_DAY, THIRD_DAY, "updates", catalog=catalog_of(elems))
    return selected.groupBy("time", "project", "collector").agg(F.count("*").alias("elem_cnt"))


def family_prefix_counts(selected: DataFrame) -> DataFrame:
    facts = (
        selected.select(*PEER_KEYS, R.family(F.col("prefix")).alias("family"), "prefix")
        .distinct()
        .withColumn("pfxs", F.col("prefix").isNotNull().cast("int"))
    )
    rows = climb_levels(facts, ["family"], ["prefix"], ["pfxs"])
    counted = rows.groupBy(*LEVEL_KEYS).agg(*[
        F.coalesce(F.sum(F.when(F.col("family") == family, F.col("pfxs"))), F.lit(0))
        .alias(f"pfxs_v{family}") for family in (4, 6)
    ])
    return label_levels(counted, "pfxs_v4", "pfxs_v6")


def level_labels(selected: DataFrame) -> DataFrame:
    rows = selected.groupBy(*PEER_KEYS).agg(F.count("*").alias("elem_cnt"))
    rows = rows.withColumn("level", F.lit(PEER))
    rows = climb(rows, PEER, COLLECTOR_KEYS, sums=["elem_cnt"])
    rows = climb(rows, COLLECTOR, TIME_KEYS, sums=["elem_cnt"])
    return label_levels(rows, "level", "elem_cnt")


def distinct_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elems_from_lineitem(spark, sf_dir).select("as_path").distinct()


def path_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        elems_from_lineitem(spark, sf_dir)
        .select(F.explode(R.tokens(F.col("as_path"))).alias("asn"))
        .groupBy("asn").agg(F.count("*").alias("cnt"))
    )


def path_squash(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("as_path")
    return distinct_paths(spark, sf_dir).select(
        path, R.squash(path).alias("squashed"),
        F.size(R.hops(path)).cast("long").alias("hop_cnt"),
    ).where(path.isNotNull())


def path_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_paths(spark, sf_dir).select(
        "as_path", R.origin(F.col("as_path")).alias("origin"),
        R.is_valid_origin(R.origin(F.col("as_path"))).alias("is_valid"),
    )


def path_transit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        distinct_paths(spark, sf_dir)
        .select("as_path", R.hops(F.col("as_path")).alias("hops"))
        .select("as_path", F.explode(F.array_distinct(R.interior(F.col("hops")))).alias("transit_asn"))
    )


def community_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        elems_from_lineitem(spark, sf_dir)
        .select("peer_asn", F.explode("communities").alias("community"))
        .groupBy("peer_asn", F.col("community.asn").alias("asn"),
                 F.col("community.value").alias("value"),
                 F.col("community.asn").eqNullSafe(F.col("peer_asn")).alias("is_internal"))
        .agg(F.count("*").alias("cnt"))
    )


def origins_as_text(table: DataFrame) -> DataFrame:
    return table.withColumn("origins", F.array_join("origins", " "))


def legacy(kind: str) -> Callable[[DataFrame], DataFrame]:
    return lambda selected: plans.to_legacy_layout(plans.REPORTS[kind](selected), kind)


QUERIES: dict[str, Query] = {
    "select_elems": over(updates, selected_rows),
    "collectors_in_projects": collectors_in_projects,
    "catalog_selection": catalog_selection,
    "family_prefix_counts": over(updates, family_prefix_counts),
    "path_tokens": path_tokens,
    "path_squash": path_squash,
    "path_origin": path_origin,
    "path_transit": path_transit,
    "community_explode": community_explode,
    "level_labels": over(updates, level_labels),
    "prefix_origins": over(updates, lambda s: origins_as_text(plans.prefix_origins(s))),
    "moas_detail": over(updates, lambda s: origins_as_text(plans.moas_detail(s))),
    "transit_detail": over(updates, plans.transit_detail),
    "community_detail": over(updates, plans.community_detail),
    **{kind: over(updates, plan) for kind, plan in plans.REPORTS.items()},
    **{f"{kind}_ribs": over(ribs, plan) for kind, plan in plans.REPORTS.items()},
    **{f"{kind}_one_collector": over(one_collector, plan)
       for kind, plan in plans.REPORTS.items()},
    "elem_counts_bitmaps": over(updates, plans.elem_counts_of_close_records),
    "elem_counts_bitmaps_ribs": over(ribs, plans.elem_counts_of_close_records),
    "catalog_that_disagrees": catalog_that_disagrees,
    "edge_paths": edge_paths,
    **{f"{kind}_edges": over(edges, plan) for kind, plan in plans.REPORTS.items()},
    "prefix_origins_edges": over(edges, lambda s: origins_as_text(plans.prefix_origins(s))),
    **{f"{kind}_from_records": over(from_records, plans.REPORTS[kind])
       for kind in ("elem_counts", "community")},
    **{f"{kind}_by_hour": over(hours, plan) for kind, plan in plans.REPORTS.items()},
    **{f"{kind}_hours_and_days": over(hours, hours_and_days(plan))
       for kind, plan in plans.REPORTS.items()},
    **{f"{kind}_legacy": over(updates, legacy(kind))
       for kind in ("routing_table", "moas", "transit", "community")},
}
