"""Nothing is dropped without a word, and no result replaces another."""

import pytest
from conftest import DAY
from pyspark.sql import functions as F

from routelens import build_report, read_collectors, read_elems, run_report, write_elems
from routelens.__main__ import main

SPAN = (DAY, DAY + 86_400, "updates")


@pytest.fixture()
def elems(elems_of):
    return elems_of(dict(prefix="10.0.0.0/24", as_path="1 2 3"),
                    dict(prefix="10.0.1.0/24", as_path="1 2 4", collector="rrc01"))


@pytest.mark.parametrize("day", ["20160101", "'20160101'", "DATE'2016-01-01'"])
def test_a_column_called_day_changes_nothing(elems, day):
    with_day = elems.withColumn("day", F.expr(day))
    assert (build_report("routing_table", with_day, *SPAN).collect()
            == build_report("routing_table", elems, *SPAN).collect())


@pytest.mark.parametrize("line", ['{"record_id": 1, "rec', '{"record_time": "noon"}'])
def test_bad_json_is_an_error(spark, elems, tmp_path, line):
    (tmp_path / "elems.json").write_text("\n".join([*elems.toJSON().collect(), line]))
    with pytest.raises(Exception, match="(?i)malformed"):
        build_report("routing_table", read_elems(spark, str(tmp_path / "elems.json"), "json"),
                     *SPAN).collect()


def test_a_missing_column_is_named(spark, elems, tmp_path):
    elems.withColumnRenamed("as_path", "path").write.parquet(str(tmp_path / "e"))
    with pytest.raises(ValueError, match="as_path"):
        read_elems(spark, str(tmp_path / "e"))


@pytest.mark.parametrize("text", ['{"data": {"collectors": {"rrc00": {"proj', '{"data": {}}'])
def test_a_broken_catalogue_is_an_error(spark, tmp_path, text):
    (tmp_path / "c.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|data.collectors"):
        read_collectors(spark, str(tmp_path / "c.json")).collect()


def test_results_do_not_replace_each_other(spark, elems, tmp_path):
    def run(**options):
        return run_report("routing_table", elems, *SPAN, outdir=str(tmp_path), **options)

    paths = {run(), run(legacy=True), run(collector="nosuch")}
    assert len(paths) == 3
    with pytest.raises(Exception, match="(?i)exists"):
        run()
    assert run(overwrite=True) in paths


def test_daily_loads(spark, elems, elems_of, tmp_path):
    path = str(tmp_path / "e")
    write_elems(elems, path)
    with pytest.raises(Exception, match="(?i)exists"):
        write_elems(elems, path)
    write_elems(elems_of(dict(record_time=DAY + 86_400)), path, "append")
    assert read_elems(spark, path).count() == 3
    write_elems(elems_of(dict(prefix="10.9.0.0/24")), path, "replace")
    assert sorted((r.record_time - DAY, r.collector, r.prefix) for r in read_elems(spark, path).collect()
                  if r.record_time == DAY) == [(0, "rrc00", "10.9.0.0/24"), (0, "rrc01", "10.0.1.0/24")]
    assert read_elems(spark, path).count() == 3


def test_main(spark, elems, tmp_path):
    elems.write.parquet(str(tmp_path / "e"))
    paths = main(["routing_table", "--start", str(DAY), "--end", str(DAY + 1), "--type", "updates",
                  "--input", str(tmp_path / "e"), "--outdir", str(tmp_path), "--format", "parquet"])
    assert spark.read.parquet(*paths).count() > 0
