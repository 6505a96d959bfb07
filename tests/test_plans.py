"""The physical plans a large table depends on."""

import json
import re

import pytest
from conftest import DAY

from routelens import build_details, build_report, read_collectors, read_elems, write_elems
from routelens.plans import REPORTS, elem_fields
from routelens.schema import NESTED_RECORDS

SPAN = (DAY, DAY + 86_400)


@pytest.fixture(scope="module")
def table(elems_of, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "elems")
    write_elems(elems_of(
        dict(prefix="10.0.0.0/8", as_path="1 2 9", communities=[(1, 5)]),
        dict(prefix="11.0.0.0/8", collector="rv2", project="routeviews"),
        dict(prefix="12.0.0.0/8", record_time=DAY + 86_400),
    ), path)
    return path


@pytest.fixture(scope="module", autouse=True)
def whole_metadata(spark):
    """Plans print long schemas and filters in full."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, table):
    return {kind: plan_of(build_report(kind, read_elems(spark, table), *SPAN, "updates"))
            for kind in REPORTS}


@pytest.mark.parametrize("kind", REPORTS)
def test_one_scan_no_python_no_gathering(plans, kind):
    plan = plans[kind]
    assert plan.count("FileScan") == 1
    for operator in ("Python", "Pandas", "Arrow", "Join", "Cartesian", "Window",
                     "SinglePartition", "CollectLimit"):
        assert operator not in plan, operator


@pytest.mark.parametrize("kind", ["elem_counts", "routing_table", "moas", "transit", "community"])
def test_levels_are_climbed_two_at_a_time_by_hash(plans, kind):
    plan = plans[kind]
    expands = re.findall(r"Expand \[(.*)\], \[[^\[\]]*\]\n", plan)
    assert len(expands) == 2
    assert all(expand.count("[") == 2 for expand in expands), expands
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


@pytest.mark.parametrize("kind, unread", [
    ("elem_counts", {"prefix", "as_path", "communities", "elem_type"}),
    ("routing_table", {"record_id", "communities", "elem_type"}),
    ("moas", {"record_id", "communities", "elem_type"}),
    ("transit", {"record_id", "communities", "elem_type"}),
    ("community", {"record_id", "as_path", "elem_type"}),
])
def test_column_pruning(plans, kind, unread):
    read = set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*)>", plans[kind]).group(1)))
    assert not read & unread
    assert "peer_asn" in read


@pytest.mark.parametrize("kind", REPORTS)
def test_filters_reach_the_scan(plans, kind):
    scan = next(line for line in plans[kind].splitlines() if "FileScan" in line)
    partition = scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    pushed = scan.split("PushedFilters: [")[1]
    assert "routelens_day" in partition and "record_type" in partition
    assert "record_time" in pushed and "project" in pushed


def test_small_catalogue_is_broadcast_and_prunes_directories(spark, table, tmp_path):
    path = tmp_path / "collectors.json"
    path.write_text(json.dumps({"data": {"collectors": {
        "rrc00": {"project": "ris"}, "mine": {"project": "other"}}}}))
    catalog = read_collectors(spark, str(path))
    report = build_report("routing_table", read_elems(spark, table), *SPAN, "updates",
                          catalog=catalog)
    assert {row.pfxs_v4 for row in report.collect()} == {1}
    plan = plan_of(report)
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    assert "SortMergeJoin" not in plan
    assert "dynamicpruning" in plan


def test_origins_are_gathered_only_where_prefixes_have_several(spark, table):
    """Arrays and their sort stand above the semi-join with the contested prefixes."""
    details = plan_of(build_details("moas_detail", read_elems(spark, table), *SPAN, "updates"))
    assert "LeftSemi" in details
    above = details[:details.index("LeftSemi")]
    assert "collect_set" in above and "collect_set" not in details[details.index("LeftSemi"):]


@pytest.mark.parametrize("kind", REPORTS)
def test_longer_spans_add_one_merging_step(spark, table, kind):
    plan = plan_of(build_report(kind, read_elems(spark, table), *SPAN, "updates", granularity=3600,
                                longer=(86_400,)))
    expands = re.findall(r"Expand \[(.*)\], \[[^\[\]]*\]\n", plan)
    assert len(expands) == 3 and plan.count("FileScan") == 1 and "Join" not in plan


def test_nested_columns_are_pruned_through_the_explode(spark, elems_of, tmp_path):
    record, elem = (7, "ris", "rrc00", "updates", DAY), (1, "192.0.2.1", "10.0.0.0/8", "1 2", None, "A")
    spark.createDataFrame([(*record, [elem])], NESTED_RECORDS).write.parquet(str(tmp_path / "n"))
    path = str(tmp_path / "n")
    for kind, wanted in (("elem_counts", ""), ("moas", ",prefix:string,as_path:string")):
        report = build_report(kind, read_elems(spark, path, nested=True, fields=elem_fields([kind])), *SPAN, "updates")
        schema = re.search(r"ReadSchema: (.*)", plan_of(report)).group(1)
        assert f"elems:array<struct<peer_asn:bigint,peer_address:string{wanted}>>" in schema
        whole = build_report(kind, read_elems(spark, path, nested=True), *SPAN, "updates")
        assert sorted(report.collect()) == sorted(whole.collect()) and whole.count() == 3
    assert {*elem_fields(REPORTS)} == {"peer_asn", "peer_address", "prefix", "as_path", "communities"}
