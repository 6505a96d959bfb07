"""Result granularity, and several spans in one report."""

import pytest
from conftest import DAY

from routelens import build_report, run_report, select_elems
from routelens.job import report_path
from routelens.operators import time_bounds
from routelens.plans import REPORTS, community_detail, moas_detail, prefix_origins, transit_detail

HOUR = 3600
FLAGS = ("span",)


@pytest.fixture(scope="module")
def elems(elems_of):
    return elems_of(*[
        dict(record_id=i % 7, prefix=f"10.{i % 5}.0.0/16" if i % 9 else None,
             as_path=f"{i % 3} {i % 4} {i % 6}", communities=[(i % 3, i % 2)], peer_asn=i % 3,
             peer_address=f"192.0.2.{i % 3}", collector=f"rrc0{i % 2}", record_time=DAY + i * 977)
        for i in range(250)])


def rows(report):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in report.collect())


@pytest.mark.parametrize("kind", REPORTS)
def test_each_span_is_the_report_of_that_granularity(elems, kind):
    bounds = (DAY, DAY + 3 * 86_400, "updates")
    both = build_report(kind, elems, *bounds, granularity=HOUR, longer=(6 * HOUR, 86_400))
    assert both.columns[:2] == ["time", "span"]
    for span in (HOUR, 6 * HOUR, 86_400):
        alone = build_report(kind, elems, *bounds, granularity=span)
        assert rows(both.where(f"span = {span}").drop("span")) == rows(alone)
        assert {row.time % span for row in alone.collect()} == {0}


@pytest.mark.parametrize("plan", [community_detail, moas_detail, prefix_origins, transit_detail])
def test_detail_tables_of_several_spans(elems, plan):
    bounds = (DAY, DAY + 3 * 86_400, "updates")
    both = plan(select_elems(elems, *bounds, granularity=HOUR), spans=(HOUR, 86_400))
    for span in (HOUR, 86_400):
        alone = plan(select_elems(elems, *bounds, granularity=span))
        assert rows(both.where(f"span = {span}").drop("span")) == rows(alone)


def test_bounds_are_rounded_out_to_the_longest_span():
    assert time_bounds(DAY + 1, DAY + HOUR + 1, HOUR) == (DAY, DAY + 2 * HOUR)
    assert time_bounds(DAY + HOUR + 1, DAY + HOUR + 2) == (DAY, DAY + 86_400)
    assert time_bounds(DAY, DAY) == (DAY, DAY)


def test_rounding_selects_whole_buckets(elems):
    part = build_report("elem_counts", elems, DAY + 100, DAY + HOUR + 5, "updates", granularity=HOUR)
    assert {row.time for row in part.collect()} == {DAY, DAY + HOUR}
    whole = build_report("elem_counts", elems, DAY + 100, DAY + HOUR + 5, "updates", granularity=HOUR, longer=(86_400,))
    assert {row.time for row in whole.where("span = 3600").collect()} >= {DAY + i * HOUR for i in range(24)}


def test_bad_spans(elems):
    for granularity, longer in ((0, ()), (HOUR, (HOUR,)), (HOUR, (5000,)), (-5, ())):
        with pytest.raises(ValueError):
            build_report("moas", elems, DAY, DAY + 1, "updates", granularity=granularity, longer=longer)


def test_paths_and_files(spark, elems, tmp_path):
    assert report_path("o", "moas", "ribs", DAY + 1, DAY + 2, granularity=HOUR) == (
        "o/bgp-moas.ribs.2016-01-01T000000-2016-01-01T010000.3600s.csv")
    assert report_path("o", "moas", "ribs", DAY + 1, DAY + 2, granularity=HOUR, longer=(86_400,)) == (
        "o/bgp-moas.ribs.2016-01-01-2016-01-02.3600s-86400s.csv")
    given = dict(granularity=HOUR, longer=(86_400,))
    path = run_report("community", elems, DAY, DAY + 86_400, "updates", str(tmp_path), format="parquet", **given)
    want = build_report("community", elems, DAY, DAY + 86_400, "updates", **given)
    assert rows(spark.read.parquet(path)) == rows(want)


def test_legacy_titles_with_a_span(elems):
    report = build_report("moas", elems, DAY, DAY + 86_400, "updates", legacy=True, granularity=HOUR, longer=(86_400,))
    assert report.columns[:4] == ["Time", "Span", "Collector", "Peer"]
