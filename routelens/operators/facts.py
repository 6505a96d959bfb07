"""Turning elems into distinct facts.

A fact says that one vantage point saw one thing on one day. Each function
dedupes its facts per vantage point in one aggregation: copies collapse before
the shuffle, and the shuffle hashes vantage point and thing together, so neither
a busy peer nor a popular prefix lands in one task.

Every elem yields at least one row, if need be with NULL for family and thing,
so that a peer whose elems carry no prefix keeps its row in the reports. That
row is a NULL put in front of each exploded array.

The 0/1 columns say what a fact counts towards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.functions import family, hops, interior, is_valid_origin, origin, tokens
from routelens.schema import PEER_KEYS


def _explode_after_null(items: str, element_type: str) -> Column:
    """Explode NULL, then the items of an array column that may itself be NULL."""
    return F.expr(f"explode(concat(array(cast(NULL AS {element_type})),"
                  f" coalesce({items}, array())))")


def distinct_elems(selected: DataFrame) -> DataFrame:
    """What a vantage point said on a day, each statement once.

    All reports but the element counts are functions of this. RIB dumps and
    flapping routes repeat statements many times a day, so where several reports
    are wanted it is worth writing out once.
    """
    return selected.select(*PEER_KEYS, "prefix", "as_path", "communities").distinct()


def record_facts(selected: DataFrame) -> DataFrame:
    """Per vantage point and record: its number of elems."""
    return selected.groupBy(*PEER_KEYS, "record_id").agg(
        F.count("*").alias("elem_cnt"), F.lit(1).alias("record_cnt"))


def routing_facts(selected: DataFrame) -> DataFrame:
    """Prefixes, and the ASNs in paths of elems that have a prefix.

    A peer says the same path of many prefixes and many times a day, so its paths are made distinct
    per family before they are cut into ASNs.
    """
    return (
        selected
        .select(*PEER_KEYS, family(F.col("prefix")).alias("family"), F.expr(
            "inline(array(struct(prefix, cast(NULL AS string) AS as_path),"
            " struct(cast(NULL AS string) AS prefix, if(prefix IS NULL, NULL, as_path) AS as_path)))"))
        .distinct()
        .select(*PEER_KEYS, "family", "prefix", F.explode_outer(tokens(F.col("as_path"))).alias("asn"))
        .distinct()
        .selectExpr("*", "int(prefix IS NOT NULL) AS pfxs", "int(asn IS NOT NULL) AS asns")
    )


def origin_facts(selected: DataFrame) -> DataFrame:
    """Prefixes with their valid origins, and a NULL origin where an elem has none."""
    valid = F.col("prefix").isNotNull() & is_valid_origin(F.col("origin"))
    return (
        selected
        .select(*PEER_KEYS, "prefix", origin(F.col("as_path")).alias("origin"))
        .select(*PEER_KEYS, "prefix", F.when(valid, F.col("origin")).alias("origin"))
        .distinct()
    )


def transit_facts(selected: DataFrame) -> DataFrame:
    """Prefixes (NULL transit) and the (transit hop, prefix) pairs.

    ``via`` on a prefix says that some path to it has a transit hop. An empty
    prefix counts as a prefix but is never forwarded.
    """
    prefix, path = F.col("prefix"), F.col("as_path")
    return (
        selected
        .select(*PEER_KEYS, "prefix", F.when(prefix != "", hops(path)).alias("hops"))
        .select(*PEER_KEYS, "prefix", interior(F.col("hops")).alias("transits"))
        .select(*PEER_KEYS, "prefix", F.expr("int(coalesce(size(transits), 0) > 0) AS via"),
                _explode_after_null("transits", "string").alias("transit"))
        .groupBy(*PEER_KEYS, family(prefix).alias("family"), "transit", "prefix")
        .agg(F.max("via").alias("via"))
        .selectExpr("*", "int(prefix IS NOT NULL) AS pfxs")
    )


def community_facts(selected: DataFrame) -> DataFrame:
    """Prefixes with their kinds of community, and the (asn, value) communities.

    Whether a community is the peer's own is settled here, against the peer of
    the elem; above the peer level it can no longer be told. A community without
    an ASN is not the peer's own. An empty prefix counts as a prefix but has no
    communities.
    """
    return (
        selected
        .select(*PEER_KEYS, "prefix", F.expr(
            "if(prefix <> '' AND size(communities) > 0, communities, NULL) AS communities"))
        .select(
            *PEER_KEYS, "prefix",
            F.expr("communities IS NOT NULL AS `any`"),
            F.expr("coalesce(array_contains(communities.asn, peer_asn), false) AS `int`"),
            F.expr("coalesce(size(array_remove(communities.asn, peer_asn)) > 0, false) AS `ext`"),
            _explode_after_null("communities", "struct<asn: bigint, value: bigint>")
            .alias("community"),
        )
        .select(
            *PEER_KEYS, family(F.col("prefix")).alias("family"),
            F.col("community.asn").alias("asn"), F.col("community.value").alias("value"),
            F.expr("if(community IS NULL, prefix, NULL) AS prefix"),
            F.expr("int(community IS NOT NULL) AS pairs"),
            *[F.expr(f"int(community IS NULL AND `{kind}`) AS `{kind}`")
              for kind in ("any", "int", "ext")],
        )
        .groupBy(*PEER_KEYS, "family", "asn", "value", "prefix", "pairs")
        .agg(*[F.max(kind).alias(kind) for kind in ("any", "int", "ext")])
        .selectExpr("*", "int(prefix IS NOT NULL) AS pfxs")
    )


def community_prefix_facts(selected: DataFrame) -> DataFrame:
    """The prefixes on which each (asn, value) community was seen."""
    return (
        selected.where("prefix <> ''")
        .select(*PEER_KEYS, "prefix", F.explode("communities").alias("community"))
        .select(*PEER_KEYS, family(F.col("prefix")).alias("family"),
                F.col("community.asn").alias("asn"), F.col("community.value").alias("value"),
                "prefix")
        .distinct()
        .withColumn("pfxs", F.lit(1))
    )
