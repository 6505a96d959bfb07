import json
from pathlib import Path

import pytest
from conftest import DAY

from routelens import (
    build_report,
    flatten_records,
    read_collectors,
    read_elems,
    run_report,
    run_reports,
    write_elems,
)
from routelens.job import report_path
from routelens.plans import REPORTS
from routelens.schema import ELEMS, NESTED_RECORDS

SPAN = (DAY, DAY + 2 * 86_400)


@pytest.fixture(scope="module")
def elems(elems_of):
    return elems_of(
        dict(prefix="10.0.0.0/8", as_path="1 2 9", communities=[(1, 5)]),
        dict(prefix="10.0.0.0/8", as_path="1 3 8", record_time=DAY + 86_400),
        dict(prefix="11.0.0.0/8", collector="rv2", project="routeviews"),
        dict(prefix="12.0.0.0/8", record_type="ribs"),
        dict(prefix="13.0.0.0/8", collector="mine", project="other"),
    )


def test_read_collectors(spark, tmp_path):
    path = tmp_path / "collectors.json"
    path.write_text(json.dumps({"data": {"collectors": {
        "rrc00": {"project": "ris", "dataTypes": {}}, "mine": {"project": "other"}}}}, indent=2))
    rows = {tuple(row) for row in read_collectors(spark, str(path)).collect()}
    assert rows == {("rrc00", "ris"), ("mine", "other")}


def test_layout_round_trip(spark, elems, tmp_path):
    path = str(tmp_path / "elems")
    write_elems(elems, path)
    back = read_elems(spark, path)
    assert set(back.columns) == {*ELEMS.fieldNames(), "routelens_day"}
    assert dict(back.dtypes)["communities"] == dict(elems.dtypes)["communities"]
    names = ELEMS.fieldNames()
    assert sorted(map(str, back.select(*names).collect())) == sorted(
        map(str, elems.select(*names).collect()))


def test_layout_prunes_directories(spark, elems, tmp_path):
    path = str(tmp_path / "elems")
    write_elems(elems, path)
    report = build_report("routing_table", read_elems(spark, path), DAY, DAY + 86_400, "updates",
                          collector="rrc00")
    assert {r.pfxs_v4 for r in report.collect()} == {1}
    plan = report._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    for column in ("routelens_day", "record_type", "collector"):
        assert column in filters


def test_plain_parquet_and_json(spark, elems, tmp_path):
    elems.write.parquet(str(tmp_path / "p"))
    elems.write.json(str(tmp_path / "j"))
    expected = sorted(map(str, build_report("community", elems, *SPAN, "updates").collect()))
    for path, fmt in (("p", "parquet"), ("j", "json")):
        got = build_report("community", read_elems(spark, str(tmp_path / path), fmt),
                           *SPAN, "updates")
        assert sorted(map(str, got.collect())) == expected


def test_nested_records(spark, tmp_path):
    record = (7, "ris", "rrc00", "updates", DAY)
    elem = (1, "192.0.2.1", "10.0.0.0/8", "1 2", None, "A")
    nested = spark.createDataFrame([(*record, [elem, elem]), (*record, []), (*record, None)],
                                   NESTED_RECORDS)
    flat = flatten_records(nested)
    assert flat.columns == ELEMS.fieldNames() and flat.count() == 2
    nested.write.json(str(tmp_path / "n"))
    assert read_elems(spark, str(tmp_path / "n"), "json", nested=True).count() == 2


def test_report_path():
    assert report_path("out/", "routing_table", "updates", DAY + 1, DAY + 86_401) == (
        "out/bgp-routingtable.updates.2016-01-01-2016-01-03.csv")


@pytest.mark.parametrize("legacy", [False, True])
def test_csv_round_trip(spark, elems, tmp_path, legacy):
    path = run_report("transit", elems, *SPAN, "updates", str(tmp_path), legacy=legacy)
    expected = build_report("transit", elems, *SPAN, "updates", legacy=legacy)
    back = spark.read.schema(expected.schema).csv(path, header=True, enforceSchema=False)
    rows = [tuple(row) for row in back.collect()]
    assert sorted(rows) == sorted(tuple(row) for row in expected.collect())
    levels = [(row[1] == "ALL-COLLECTORS") + (row[2] == "ALL-PEERS") for row in rows]
    assert levels == sorted(levels)
    files = list((tmp_path / path.split("/")[-1]).glob("part-*.csv"))
    assert len(files) == 1


def test_parquet_sink(spark, elems, tmp_path):
    path = run_report("moas", elems, *SPAN, "updates", str(tmp_path), format="parquet")
    assert path.endswith(".parquet")
    expected = build_report("moas", elems, *SPAN, "updates")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(
        map(tuple, expected.collect()))


def test_reports_from_one_pass(spark, elems, tmp_path):
    work = Path(spark.conf.get("spark.checkpoint.dir", None) or tmp_path)
    before = set(work.iterdir()) if work.exists() else set()
    twice = elems.unionAll(elems)
    paths = run_reports(REPORTS, twice, *SPAN, "updates", str(tmp_path / "out"),
                        format="parquet", workdir=str(work))
    assert list(paths) == list(REPORTS)
    for kind, path in paths.items():
        expected = build_report(kind, twice, *SPAN, "updates")
        assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(
            map(tuple, expected.collect()))
    left = set(work.iterdir()) - before - {tmp_path / "out"}
    assert not left


def test_unknown_kind(elems):
    with pytest.raises(ValueError):
        build_report("speed", elems, *SPAN, "updates")
    with pytest.raises(ValueError):
        build_report("elem_counts", elems, *SPAN, "updates", legacy=True)
