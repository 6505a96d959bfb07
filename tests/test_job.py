"""Growing reports, detail tables as files, scratch tables, and reading with an account."""

import json
from pathlib import Path

import pytest
from conftest import DAY

from routelens import (
    RejectedRows,
    build_details,
    build_report,
    read_details,
    read_elems,
    read_elems_with_account,
    read_report,
    run_details,
    run_report,
    update_report,
)
from routelens.__main__ import main
from routelens.plans import DETAILS, REPORTS
from routelens.schema import ELEMS, NESTED_RECORDS
from routelens.sources import ScratchTables

DAYS = [DAY + i * 86_400 for i in range(4)]


def rows(table):
    return sorted(map(repr, map(tuple, table.collect())))


@pytest.fixture(scope="module")
def made():
    return [dict(prefix=f"10.{i % 4}.0.0/16" if i % 7 else "2001:db8::/32", as_path=f"1 {i % 3} {i % 5}",
                 communities=[(1, i % 2), (2, 3)], record_time=DAYS[i % 3], record_id=i,
                 peer_asn=1 + i % 2, peer_address=f"192.0.2.{1 + i % 2}") for i in range(60)]


@pytest.fixture(scope="module")
def elems(elems_of, made):
    return elems_of(*made)


def state(path):
    """Files of each directory of a report, with their times of change."""
    return {part.name: {(f.name, f.stat().st_mtime_ns) for f in part.glob("part-*")}
            for part in Path(path).glob("time=*")}


@pytest.mark.parametrize("kind", ["moas", "transit"])
@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_one_day_is_replaced_alone(spark, elems, elems_of, made, tmp_path, kind, format):
    given = dict(outdir=str(tmp_path), format=format)
    path = update_report(kind, elems, DAYS[0], DAYS[2], "updates", **given)
    assert rows(read_report(spark, kind, path, format)) == rows(build_report(kind, elems, DAYS[0], DAYS[2], "updates"))
    first = state(path)
    # A third day is added; the two that are there stay, though their elems have changed since.
    changed = elems_of(*made, dict(prefix="11.0.0.0/8", as_path="1 2 3", record_time=DAYS[1]))
    assert update_report(kind, changed, DAYS[0], DAYS[3], "updates", **given) == path
    after = state(path)
    assert {name: after[name] for name in first} == first and len(after) == 3
    assert rows(read_report(spark, kind, path, format)) == rows(build_report(kind, elems, DAYS[0], DAYS[3], "updates"))
    # The second day made anew changes its directory alone.
    update_report(kind, changed, DAYS[1], DAYS[2], "updates", replace=True, **given)
    last = state(path)
    different = {name for name in after if last[name] != after[name]}
    assert different == {f"time={DAYS[1]}"} and set(last) == set(after)
    assert rows(read_report(spark, kind, path, format)) == rows(
        build_report(kind, changed, DAYS[0], DAYS[3], "updates"))


def test_nothing_to_add(spark, elems, tmp_path):
    for _ in range(2):
        path = update_report("elem_counts", elems, DAYS[0], DAYS[3], "updates", str(tmp_path), granularity=3600)
    assert ".3600s." in path
    assert rows(read_report(spark, "elem_counts", path)) == rows(
        build_report("elem_counts", elems, DAYS[0], DAYS[3], "updates", granularity=3600))


@pytest.mark.parametrize("kind", DETAILS)
@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_details_round_trip(spark, elems, tmp_path, kind, format):
    path = run_details(kind, elems, DAYS[0], DAYS[3], "updates", str(tmp_path), format=format)
    want = build_details(kind, elems, DAYS[0], DAYS[3], "updates")
    back = read_details(spark, kind, path, format)
    assert (back.columns, [t for _, t in back.dtypes]) == (want.columns, [t for _, t in want.dtypes])
    assert rows(back) == rows(want) and want.count() > 5
    assert (Path(path) / f"time={DAYS[0]}" / "family=6").is_dir()
    one = back.where(f"time = {DAYS[1]} AND family = 6")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "family" in plan.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        run_details(kind, elems, DAYS[0], DAYS[3], "updates", str(tmp_path), format=format)


def test_details_of_two_spans(spark, elems, tmp_path):
    given = dict(granularity=3600, longer=(86_400,))
    path = run_details("prefix_origins", elems, DAYS[0], DAYS[3], "updates", str(tmp_path), **given)
    want = build_details("prefix_origins", elems, DAYS[0], DAYS[3], "updates", **given)
    back = read_details(spark, "prefix_origins", path)
    assert back.columns == want.columns and rows(back) == rows(want)


def test_prefixes_without_origins_survive_csv(spark, elems_of, tmp_path):
    odd = elems_of(dict(prefix=""), dict(prefix="a b", as_path="1 2"))
    path = run_details("prefix_origins", odd, DAYS[0], DAYS[1], "updates", str(tmp_path))
    assert rows(read_details(spark, "prefix_origins", path)) == rows(
        build_details("prefix_origins", odd, DAYS[0], DAYS[1], "updates"))


def test_scratch_tables_leave_nothing(spark, tmp_path):
    with ScratchTables(spark, f"file://{tmp_path}") as scratch:
        first = scratch.write(spark.range(3))
        second = scratch.write(first.selectExpr("id + 1 AS x"))
        scratch.drop_all_but(1)
        assert sorted(r.x for r in second.collect()) == [1, 2, 3]
        assert len(list(tmp_path.glob("routelens_*/*"))) == 1
    assert not list(tmp_path.iterdir())
    with pytest.raises(ZeroDivisionError), ScratchTables(spark, str(tmp_path)) as scratch:
        scratch.write(spark.range(3))
        raise ZeroDivisionError
    assert not list(tmp_path.iterdir())
    assert not [d for d in spark.catalog.listDatabases() if d.name.startswith("routelens_")]


def lines_of(elems, path, broken):
    elems.write.json(str(path / "json"))
    with open(path / "json" / "more.json", "w") as file:
        file.writelines(f"{line}\n" for line in broken)
    return str(path / "json")


BROKEN = ['{"record_id": 1, "project": "ris"', "no json", '{"record_id": "one"}']


def test_account_of_a_read(spark, elems, tmp_path):
    path = lines_of(elems, tmp_path, BROKEN)
    read, account = read_elems_with_account(spark, path, "json", most_rejected=3)
    assert read.columns == ELEMS.fieldNames()
    written = run_report("moas", read, DAYS[0], DAYS[1], "updates", str(tmp_path / "out"), account=account,
                         workdir=str(tmp_path / "work"))
    assert account.counts() == {"read": 63, "selected": 20, "rejected": 3}
    back = spark.read.csv(written, header=True)
    assert back.count() == build_report("moas", elems, DAYS[0], DAYS[1], "updates").count()


@pytest.mark.parametrize("most", [0, 2])
def test_too_many_rejected_rows_end_the_job(spark, elems, tmp_path, most):
    path = lines_of(elems, tmp_path, BROKEN)
    read, account = read_elems_with_account(spark, path, "json", most_rejected=most)
    with pytest.raises(RejectedRows, match="3"):
        run_report("moas", read, DAYS[0], DAYS[1], "updates", str(tmp_path / "out"), account=account,
                   workdir=str(tmp_path / "work"))
    assert not (tmp_path / "out").exists()


def test_account_of_whole_input(spark, elems, tmp_path):
    elems.write.parquet(str(tmp_path / "p"))
    read, account = read_elems_with_account(spark, str(tmp_path / "p"))
    run_report("elem_counts", read, DAYS[1], DAYS[2], "updates", str(tmp_path / "out"), account=account,
               workdir=str(tmp_path / "work"))
    assert account.counts() == {"read": 60, "selected": 20, "rejected": 0}
    assert rows(read_elems(spark, str(tmp_path / "p"))) == rows(elems)


def test_account_without_selected_rows(spark, elems, tmp_path):
    path = lines_of(elems, tmp_path, BROKEN)
    read, account = read_elems_with_account(spark, path, "json", most_rejected=3)
    run_report("moas", read, DAYS[3], DAYS[3] + 1, "updates", str(tmp_path / "out"), account=account,
               workdir=str(tmp_path / "work"))
    assert account.counts() == {"read": 63, "selected": 0, "rejected": 3}


def test_account_of_nested_records(spark, tmp_path):
    record, elem = (7, "ris", "rrc00", "updates", DAY), (1, "192.0.2.1", "10.0.0.0/8", "1 2", None, "A")
    nested = spark.createDataFrame([(*record, [elem, elem]), (*record, [])], NESTED_RECORDS)
    path = lines_of(nested, tmp_path, ["{"])
    read, account = read_elems_with_account(spark, path, "json", nested=True, most_rejected=1)
    run_report("elem_counts", read, DAYS[0], DAYS[1], "updates", str(tmp_path / "out"), account=account,
               workdir=str(tmp_path / "work"))
    assert account.counts() == {"read": 3, "selected": 2, "rejected": 1}


def test_command_line(spark, elems, tmp_path):
    elems.write.parquet(str(tmp_path / "in"))
    span = ["--start", str(DAYS[0]), "--end", str(DAYS[2]), "--type", "updates", "--input", str(tmp_path / "in"),
            "--outdir", str(tmp_path / "out")]
    report, details = main(["moas", "moas_detail", *span])
    assert rows(read_details(spark, "moas_detail", details)) == rows(
        build_details("moas_detail", elems, DAYS[0], DAYS[2], "updates"))
    assert Path(report).is_dir()
    hourly, = main(["transit", *span, "--granularity", "3600", "--longer", "86400", "--format", "parquet"])
    assert "span" in spark.read.parquet(hourly).columns
    growing, = main(["community", *span, "--update", "--format", "parquet"])
    again, = main(["community", *span, "--update", "--replace", "--format", "parquet"])
    assert growing == again
    assert rows(read_report(spark, "community", again)) == rows(
        build_report("community", elems, DAYS[0], DAYS[2], "updates"))
    assert set(REPORTS) & set(DETAILS) == set()
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text(json.dumps({"record_id": 1}) + "\nbroken\n")
    with pytest.raises(RejectedRows):
        main(["moas", *span[:-4], "--input", str(tmp_path / "lines"), "--input-format", "json",
              "--outdir", str(tmp_path / "out2"), "--workdir", str(tmp_path / "w"), "--most-rejected", "0"])
