"""Random elems, counted once more with plain Python sets."""

import itertools
import random
import statistics
from collections import defaultdict

import pytest
from conftest import DAY, as_dict

from routelens import select_elems
from routelens.plans import (
    REPORTS,
    community_detail,
    moas_detail,
    prefix_origins,
    to_legacy_layout,
    transit_detail,
)

PREFIXES = [None, "", "10.0.0.0/8", "11.0.0.0/8", "12.0.0.0/8", "2001:db8::/32", "2001:db9::/32"]
HOPS = ["1", "2", "3", "4", "23456", "{5,6}", ""]


def random_elems(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        path = None
        if rng.random() < 0.9:
            hops = [h for h in rng.choices(HOPS, weights=[9, 9, 9, 9, 1, 1, 1], k=rng.randint(0, 5))
                    for _ in range(rng.choice([1, 1, 2]))]
            path = rng.choice([" ", " ", " ", "\t"]).join(hops)
        communities = None
        if rng.random() < 0.8:
            communities = [(rng.choice([1, 2, 3, 9, None]), rng.choice([1, 2, None]))
                           for _ in range(rng.randint(0, 3))]
        rows.append(dict(
            record_id=rng.randint(1, 60) * 10, project=rng.choice(["ris", "routeviews"]),
            collector=rng.choice(["c1", "c2", "c3"]), record_time=DAY + rng.choice([0, 86_400]),
            peer_asn=rng.randint(1, 3), peer_address=rng.choice(["a", "b"]),
            prefix=rng.choice(PREFIXES), as_path=path, communities=communities))
    for row in rows:  # a record belongs to one collector and one day
        row["record_id"] += "c1 c2 c3".split().index(row["collector"])
        row["record_id"] += 5 * (row["record_time"] > DAY)
    return rows


def keys_of(e):
    day = (e["record_time"] - DAY) // 86_400
    yield day, e["collector"], (e["project"], e["peer_asn"], e["peer_address"])
    yield day, e["collector"], None
    yield day, None, None


def version(prefix):
    return None if prefix is None else "v6" if ":" in prefix else "v4"


def transit_hops(path):
    squashed = [hop for hop, _ in itertools.groupby(path.split(" "))]
    return squashed[1:-1]


def gather(elems):
    """Per level key: everything the reports count, as sets."""
    found = defaultdict(lambda: defaultdict(set))
    for e in elems:
        prefix, path, v = e["prefix"], e["as_path"], version(e["prefix"])
        for key in keys_of(e):
            sets = found[key]
            sets["elems"].add(id(e))
            sets["records"].add(e["record_id"])
            if v is None:
                continue
            sets["pfx", v].add(prefix)
            for asn in (path or "").split():
                sets["asn", v].add(asn)
            last = (path or "").split()[-1:]
            if last and last != ["23456"] and "{" not in last[0]:
                sets["origin", v, prefix].add(last[0])
            if prefix == "":
                continue
            for hop in transit_hops(path) if path is not None else []:
                sets["via", v].add(prefix)
                sets["hops", v].add(hop)
                sets["hop", v, hop].add(prefix)
            for asn, value in e["communities"] or []:
                sets["any", v].add(prefix)
                sets["int" if asn == e["peer_asn"] else "ext", v].add(prefix)
                sets["casn", v].add(asn)
                sets["pair", v].add((asn, value))
                sets["seen", v, asn, value].add(prefix)
    return found


def expected(kind, s):
    row = {}
    if kind == "elem_counts":
        return {"elem_cnt": len(s["elems"]), "record_cnt": len(s["records"])}
    for v in ("v4", "v6"):
        prefixes = s["pfx", v]
        if kind == "routing_table":
            row |= {f"pfxs_{v}": len(prefixes), f"asns_{v}": len(s["asn", v])}
        elif kind == "moas":
            origins = [frozenset(s["origin", v, p]) for p in prefixes]
            several = [o for o in origins if len(o) > 1]
            row |= {f"total_{v}": len(prefixes), f"moas_pfxs_{v}": len(several),
                    f"unknown_origin_pfxs_{v}": sum(not o for o in origins),
                    f"origin_sets_{v}": len(set(several))}
        elif kind == "transit":
            sizes = [len(s["hop", v, hop]) for hop in s["hops", v]] or [0]
            row |= {f"total_{v}": len(prefixes), f"transit_asns_{v}": len(s["hops", v]),
                    f"transit_pfxs_{v}": len(s["via", v]), f"min_pfxs_{v}": min(sizes),
                    f"mean_pfxs_{v}": pytest.approx(statistics.mean(sizes)),
                    f"max_pfxs_{v}": max(sizes),
                    f"std_pfxs_{v}": pytest.approx(statistics.pstdev(sizes))}
        elif kind == "community":
            row |= {f"total_ip{v}": len(prefixes), f"asn_{v}": len(s["casn", v]),
                    f"asn_value_{v}": len(s["pair", v]),
                    **{f"pfx_{v}_{k}": len(s[k, v]) for k in ("any", "int", "ext")}}
    return row


def labelled(key):
    day, collector, peer = key
    return (day, collector or "ALL-COLLECTORS",
            f"AS{peer[1]}-{peer[2]}" if peer else "ALL-PEERS")


@pytest.fixture(scope="module", params=[1, 2, 3])
def case(request, elems_of):
    elems = random_elems(request.param)
    # One project per collector, or two peers would share a label.
    for e in elems:
        e["project"] = "ris" if e["collector"] == "c1" else "routeviews"
    selected = select_elems(elems_of(*elems), DAY, DAY + 2 * 86_400, "updates")
    return gather(elems), selected


@pytest.mark.parametrize("kind", REPORTS)
def test_reports(case, kind):
    found, selected = case
    rows = as_dict(REPORTS[kind](selected))
    want = {labelled(key): expected(kind, sets) for key, sets in found.items()}
    assert set(rows) == set(want)
    for key, row in rows.items():
        got = {k: v for k, v in row.items() if k not in ("time", "collector", "peer")}
        assert got == want[key], key


@pytest.mark.parametrize("kind", ["moas", "transit"])
def test_legacy_counting(case, kind):
    found, selected = case
    report = to_legacy_layout(REPORTS[kind](selected), kind)
    rows = {((r["Time"] - DAY) // 86_400, r["Collector"], r["Peer"]): r for r in report.collect()}
    for key, s in found.items():
        row = rows[labelled(key)]
        for v in ("v4", "v6"):
            if kind == "transit":
                assert row[f"#Pfxs_{v}"] == len(s["hops", v])
                continue
            odd = [frozenset(s["origin", v, p]) for p in s["pfx", v]
                   if len(s["origin", v, p]) != 1]
            assert row[f"#Pfxs_{v}"] == len(odd)
            assert row[f"#Origin_Sets_IP{v}"] == len(set(odd))


def detail(table, *item):
    return {((r["time"] - DAY) // 86_400, r["collector"], r["peer"], *[r[i] for i in item]): r
            for r in table.collect()}


def test_details(case):
    found, selected = case
    origins, transits, communities = {}, {}, {}
    for key, s in found.items():
        label = labelled(key)
        for v, family in (("v4", 4), ("v6", 6)):
            for p in s["pfx", v]:
                origins[*label, family, p] = sorted(s["origin", v, p])
            for hop in s["hops", v]:
                transits[*label, family, hop] = len(s["hop", v, hop])
            for asn, value in s["pair", v]:
                communities[*label, family, asn, value] = len(s["seen", v, asn, value])
    got = detail(prefix_origins(selected), "family", "prefix")
    assert {key: row["origins"] for key, row in got.items()} == origins
    got = detail(moas_detail(selected), "family", "prefix")
    assert {key: row["origins"] for key, row in got.items()} == {
        key: o for key, o in origins.items() if len(o) > 1}
    got = detail(transit_detail(selected), "family", "transit_asn")
    assert {key: row["pfx_cnt"] for key, row in got.items()} == transits
    got = detail(community_detail(selected), "family", "asn", "value")
    assert {key: row["pfx_cnt"] for key, row in got.items()} == communities
