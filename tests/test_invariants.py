"""Relations that hold between the numbers of any report."""

import os

import pytest

from __spark_entry__ import queries

DATA = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

# Pure distinct counts: a level above never has fewer.
GROWING = {
    "elem_counts": ["elem_cnt", "record_cnt"],
    "routing_table": ["pfxs", "asns"],
    "moas": ["total"],
    "transit": ["total", "transit_asns", "transit_pfxs"],
    "community": ["total_ip", "asn", "asn_value"],
}


@pytest.fixture(scope="module", params=["updates", "ribs"])
def reports(request, spark):
    suffix = "" if request.param == "updates" else "_ribs"
    return {kind: [row.asDict() for row in queries()[kind + suffix](spark, DATA).collect()]
            for kind in GROWING}


@pytest.mark.parametrize("kind", GROWING)
def test_levels_grow(reports, kind):
    rows = {(r["time"], r["collector"], r["peer"]): r for r in reports[kind]}
    for (time, collector, peer), row in rows.items():
        if collector == "ALL-COLLECTORS":
            continue
        above = (time, collector, "ALL-PEERS") if peer != "ALL-PEERS" else (
            time, "ALL-COLLECTORS", "ALL-PEERS")
        for name, value in row.items():
            if any(name == g or name.startswith((f"{g}_v", f"{g}v")) for g in GROWING[kind]):
                assert value <= rows[above][name], (name, peer)


def test_elems_add_up(reports):
    rows = reports["elem_counts"]
    for time in {r["time"] for r in rows}:
        day = [r for r in rows if r["time"] == time]
        peers = sum(r["elem_cnt"] for r in day if r["peer"] != "ALL-PEERS")
        assert peers == next(r for r in day if r["collector"] == "ALL-COLLECTORS")["elem_cnt"]


@pytest.mark.parametrize("v", ["v4", "v6"])
def test_parts_fit_their_wholes(reports, v):
    for r in reports["moas"]:
        assert r[f"moas_pfxs_{v}"] + r[f"unknown_origin_pfxs_{v}"] <= r[f"total_{v}"]
        assert r[f"origin_sets_{v}"] <= r[f"moas_pfxs_{v}"]
    for r in reports["transit"]:
        assert r[f"transit_pfxs_{v}"] <= r[f"total_{v}"]
        assert r[f"min_pfxs_{v}"] <= r[f"mean_pfxs_{v}"] <= r[f"max_pfxs_{v}"]
        assert r[f"max_pfxs_{v}"] <= r[f"transit_pfxs_{v}"]
    for r in reports["community"]:
        some, own, other = (r[f"pfx_{v}_{kind}"] for kind in ("any", "int", "ext"))
        assert max(own, other) <= some <= min(own + other, r[f"total_ip{v}"])
        assert r[f"asn_{v}"] <= r[f"asn_value_{v}"]


def test_reports_agree_on_the_totals(reports):
    def totals(kind, *names):
        return {(r["time"], r["collector"], r["peer"]): tuple(r[n] for n in names)
                for r in reports[kind]}

    want = totals("routing_table", "pfxs_v4", "pfxs_v6")
    assert totals("moas", "total_v4", "total_v6") == want
    assert totals("transit", "total_v4", "total_v6") == want
    assert totals("community", "total_ipv4", "total_ipv6") == want
