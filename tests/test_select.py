import pytest
from conftest import DAY

from routelens import select_elems
from routelens.operators import day_bounds

DAYS = (DAY, DAY + 86_400)


def collectors(selected):
    return sorted(row.collector for row in selected.select("collector").distinct().collect())


def test_bounds_round_out_to_whole_days():
    assert day_bounds(DAY + 5, DAY + 86_401) == (DAY, DAY + 2 * 86_400)
    assert day_bounds(DAY, DAY + 86_400) == (DAY, DAY + 86_400)


def test_half_open_interval(elems_of):
    elems = elems_of(*[dict(record_time=t) for t in (DAY - 1, DAY, DAY + 86_399, DAY + 86_400)])
    rows = select_elems(elems, *DAYS, "updates").select("record_time", "time").collect()
    assert sorted(tuple(row) for row in rows) == [(DAY, DAY), (DAY + 86_399, DAY)]


def test_record_type(elems_of):
    elems = elems_of(dict(record_type="ribs", record_id=1), dict(record_id=2))
    assert [r.record_id for r in select_elems(elems, *DAYS, "ribs").collect()] == [1]
    with pytest.raises(ValueError):
        select_elems(elems, *DAYS, "both")


@pytest.fixture(scope="module")
def four(elems_of):
    return elems_of(dict(collector="rrc00"), dict(collector="rv2", project="routeviews"),
                    dict(collector="mine", project="other"), dict(collector="rrc00"))


def test_default_takes_both_projects(four):
    assert collectors(select_elems(four, *DAYS, "updates")) == ["rrc00", "rv2"]


def test_named_collector_needs_no_project(four):
    assert collectors(select_elems(four, *DAYS, "updates", collector="mine")) == ["mine"]


def test_catalogue_decides_and_duplicates_nothing(spark, four):
    catalog = spark.createDataFrame(
        [("mine", "ris"), ("rrc00", "ris"), ("rrc00", "routeviews"), ("rv2", "other")],
        "collector string, project string")
    selected = select_elems(four, *DAYS, "updates", catalog=catalog)
    assert collectors(selected) == ["mine", "rrc00"]
    assert selected.count() == 3
