"""Hand-written elems with hand-counted results, one case per edge rule."""

import pytest
from conftest import ALL, COLL, DAY, ON_P2, P1, P2

from routelens.schema import REPORT_COLUMNS

PFX = "10.0.0.0/8"
V6 = "2001:db8::/32"


def values(row, *names):
    return tuple(row[name] for name in names)


def metrics(row):
    return {k: v for k, v in row.items() if k not in ("time", "collector", "peer")}


@pytest.mark.parametrize("kind", REPORT_COLUMNS)
def test_columns(report_of, kind):
    rows = report_of(kind, dict(prefix=PFX, as_path="1 2 3"))
    assert list(rows[ALL]) == ["time", "collector", "peer", *REPORT_COLUMNS[kind]]
    assert set(rows) == {P1, COLL, ALL}


# --- origins -----------------------------------------------------------------

def test_same_origin_at_two_peers_is_not_moas(report_of):
    rows = report_of("moas", dict(prefix=PFX, as_path="1 2 9"),
                     dict(prefix=PFX, as_path="3 2 9", **ON_P2))
    assert len(rows) == 4
    for row in rows.values():
        assert values(row, "total_v4", "moas_pfxs_v4", "unknown_origin_pfxs_v4",
                      "origin_sets_v4") == (1, 0, 0, 0)


def test_moas_appears_only_above_the_peers(report_of):
    rows = report_of("moas", dict(prefix=PFX, as_path="1 9"),
                     dict(prefix=PFX, as_path="3 8", **ON_P2))
    assert rows[P1]["moas_pfxs_v4"] == rows[P2]["moas_pfxs_v4"] == 0
    for level in (COLL, ALL):
        assert values(rows[level], "moas_pfxs_v4", "origin_sets_v4") == (1, 1)


def test_unknown_origin_is_resolved_above(report_of):
    rows = report_of("moas", dict(prefix=PFX), dict(prefix=PFX, as_path="3 9", **ON_P2))
    assert rows[P1]["unknown_origin_pfxs_v4"] == 1
    assert rows[P2]["unknown_origin_pfxs_v4"] == 0
    for level in (COLL, ALL):
        assert values(rows[level], "total_v4", "unknown_origin_pfxs_v4",
                      "moas_pfxs_v4") == (1, 0, 0)


def test_as_sets_and_placeholder_are_no_origins_but_are_asns(report_of):
    elems = (dict(prefix=PFX, as_path="1 {7,8}"), dict(prefix=PFX, as_path="1 23456"))
    assert report_of("moas", *elems)[ALL]["unknown_origin_pfxs_v4"] == 1
    assert report_of("routing_table", *elems)[ALL]["asns_v4"] == 3


def test_equal_origin_sets_count_once(report_of):
    rows = report_of(
        "moas",
        dict(prefix=PFX, as_path="1 8"), dict(prefix=PFX, as_path="1 9"),
        dict(prefix="11.0.0.0/8", as_path="1 9"), dict(prefix="11.0.0.0/8", as_path="1 8"),
        dict(prefix="12.0.0.0/8", as_path="1 9"), dict(prefix="12.0.0.0/8", as_path="1 7"),
        dict(prefix=V6, as_path="1 9"), dict(prefix=V6, as_path="1 8"),
    )
    assert values(rows[ALL], "moas_pfxs_v4", "origin_sets_v4", "moas_pfxs_v6",
                  "origin_sets_v6") == (3, 2, 1, 1)


# --- transit -----------------------------------------------------------------

@pytest.mark.parametrize("path, expected", [
    ("1 1 2 2 3", 1),
    ("1 2 1", 1),
    ("1 2", 0),
    ("1 1 1", 0),
    ("1", 0),
    ("", 0),
    (None, 0),
    ("1 2 1 3", 2),
    ("1 {4,5} 3", 1),
    ("1  2 3", 2),
    ("1 23456 3", 1),
    ("1 2 3 ", 2),
])
def test_transit_hops(report_of, path, expected):
    row = report_of("transit", dict(prefix=PFX, as_path=path))[ALL]
    assert values(row, "total_v4", "transit_asns_v4", "transit_pfxs_v4") == (
        1, expected, min(expected, 1))


def test_transit_statistics_are_of_the_population(report_of):
    rows = report_of("transit", dict(prefix=PFX, as_path="1 2 3 9"),
                     dict(prefix="11.0.0.0/8", as_path="1 2 9"))
    for row in rows.values():
        assert values(row, "min_pfxs_v4", "mean_pfxs_v4", "max_pfxs_v4",
                      "std_pfxs_v4") == (1, 1.5, 2, 0.5)
        assert values(row, "min_pfxs_v6", "mean_pfxs_v6", "max_pfxs_v6",
                      "std_pfxs_v6") == (0, 0.0, 0, 0.0)


def test_a_prefix_with_and_without_transit_counts_once(report_of):
    rows = report_of("transit", dict(prefix=PFX, as_path="1 9"),
                     dict(prefix=PFX, as_path="2 5 9", **ON_P2))
    assert rows[P1]["transit_pfxs_v4"] == 0
    assert values(rows[COLL], "total_v4", "transit_pfxs_v4") == (1, 1)


# --- communities -------------------------------------------------------------

def test_own_and_foreign_communities(report_of):
    rows = report_of("community", dict(prefix=PFX, communities=[(1, 5), (2, 5)]))
    for row in rows.values():
        assert values(row, "total_ipv4", "pfx_v4_any", "pfx_v4_int", "pfx_v4_ext", "asn_v4",
                      "asn_value_v4") == (1, 1, 1, 1, 2, 2)


def test_own_is_judged_by_the_peer_of_the_elem(report_of):
    rows = report_of("community", dict(prefix=PFX, communities=[(2, 5)]),
                     dict(prefix=V6, communities=[(2, 5)], **ON_P2))
    assert values(rows[COLL], "pfx_v4_int", "pfx_v4_ext", "pfx_v6_int",
                  "pfx_v6_ext") == (0, 1, 1, 0)


def test_no_and_empty_communities(report_of):
    row = report_of("community", dict(prefix=PFX), dict(prefix=V6, communities=[]))[ALL]
    assert metrics(row) == {**dict.fromkeys(REPORT_COLUMNS["community"], 0),
                            "total_ipv4": 1, "total_ipv6": 1}


def test_communities_with_missing_parts(report_of):
    row = report_of("community", dict(prefix=PFX, communities=[(None, 5), (1, None), (1, 5)]))[ALL]
    assert values(row, "pfx_v4_int", "pfx_v4_ext", "asn_v4", "asn_value_v4") == (1, 1, 2, 3)


# --- keys and rows -----------------------------------------------------------

@pytest.mark.parametrize("kind", ["routing_table", "moas", "transit", "community"])
@pytest.mark.parametrize("elem", [
    dict(),
    dict(as_path="1 2 3", communities=[(1, 5)]),
])
def test_peer_without_prefix_keeps_a_zero_row(report_of, kind, elem):
    rows = report_of(kind, elem)
    assert set(rows) == {P1, COLL, ALL}
    assert all(value == 0 for row in rows.values() for value in metrics(row).values())


def test_empty_prefix_is_a_prefix_without_transit_or_communities(report_of):
    elem = dict(prefix="", as_path="1 2 3", communities=[(1, 5)])
    assert metrics(report_of("routing_table", elem)[ALL]) == {
        "pfxs_v4": 1, "pfxs_v6": 0, "asns_v4": 3, "asns_v6": 0}
    assert values(report_of("transit", elem)[ALL], "total_v4", "transit_asns_v4") == (1, 0)
    assert values(report_of("community", elem)[ALL], "total_ipv4", "pfx_v4_any",
                  "asn_v4") == (1, 0, 0)
    assert values(report_of("moas", elem)[ALL], "total_v4", "unknown_origin_pfxs_v4") == (1, 0)


def test_tokens_split_on_any_whitespace(report_of):
    row = report_of("routing_table", dict(prefix=PFX, as_path=" 1  2\t3\n "))[ALL]
    assert row["asns_v4"] == 3
    row = report_of("moas", dict(prefix=PFX, as_path="1 2 \t"),
                    dict(prefix=PFX, as_path="1 3"))[ALL]
    assert row["moas_pfxs_v4"] == 1


def test_a_shared_record_counts_once_per_collector(report_of):
    rows = report_of("elem_counts", dict(record_id=7), dict(record_id=7),
                     dict(record_id=7, **ON_P2), dict(record_id=8, **ON_P2),
                     dict(record_id=9, collector="rrc01"))
    assert values(rows[P1], "elem_cnt", "record_cnt") == (2, 1)
    assert values(rows[P2], "elem_cnt", "record_cnt") == (2, 2)
    assert values(rows[COLL], "elem_cnt", "record_cnt") == (4, 2)
    assert values(rows[ALL], "elem_cnt", "record_cnt") == (5, 3)


def test_counts_are_unions_not_sums(report_of):
    rows = report_of(
        "routing_table",
        dict(prefix=PFX, as_path="1 2"), dict(prefix=PFX, as_path="2 2", **ON_P2),
        dict(prefix=PFX, as_path="5 2", collector="rrc01"),
        dict(prefix=V6, as_path="5 6", collector="rrc01"))
    assert metrics(rows[COLL]) == {"pfxs_v4": 1, "pfxs_v6": 0, "asns_v4": 2, "asns_v6": 0}
    assert metrics(rows[ALL]) == {"pfxs_v4": 1, "pfxs_v6": 1, "asns_v4": 3, "asns_v6": 2}


def test_days_split_at_midnight(report_of):
    rows = report_of("elem_counts", dict(record_time=DAY + 86_399), dict(record_time=DAY + 86_400))
    assert rows[ALL]["elem_cnt"] == 1
    assert rows[(1, "ALL-COLLECTORS", "ALL-PEERS")]["elem_cnt"] == 1


def test_same_asn_at_two_addresses_is_two_peers(report_of):
    rows = report_of("routing_table", dict(prefix=PFX), dict(prefix=PFX, peer_address="2001:db8::1"))
    assert set(rows) == {P1, (0, "rrc00", "AS1-2001:db8::1"), COLL, ALL}


def test_32_bit_asns(report_of):
    row = report_of("community", dict(prefix=PFX, peer_asn=4_294_967_295,
                                      communities=[(4_294_967_295, 1)]))[ALL]
    assert row["pfx_v4_int"] == 1


def test_withdrawals_count_as_prefixes(report_of):
    assert report_of("routing_table", dict(prefix=PFX, elem_type="W"))[ALL]["pfxs_v4"] == 1
