"""Origin sets counted by hash aggregates against sets gathered in Python, and the tables of origins."""

import collections
import random

import pytest
from conftest import DAY, as_dict

from routelens import select_elems
from routelens.operators import contested_prefixes, origin_facts, origin_sets_by_level
from routelens.plans import moas, moas_detail, prefix_origins

PATHS = [None, "", "1", "1 2", "1 3", "1 {4,5}", "1 23456", "2 12", "2 21", "7 1 2", "1 1.10", "5 007", "5 7",
         "5 99999999999999999999", "1 -3"]


def rows_of(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        peer = rnd.randint(1, 4)
        rows.append(dict(
            prefix=rnd.choice([None, "", *[f"10.{i}.0.0/16" for i in range(12)], "2001:db8::/32", "2001:db9::/32"]),
            as_path=rnd.choice(PATHS), peer_asn=peer, peer_address=f"192.0.2.{peer}",
            collector=rnd.choice(["rrc00", "rrc01"]), record_time=DAY + rnd.choice([0, 86_400])))
    return rows


def origin(path):
    last = (path or "").split()[-1:] or [""]
    return last[0] if last[0] not in ("", "23456") and "{" not in last[0] else None


def gathered(rows):
    """{(day, collector, peer): {prefix: set of origins}}."""
    levels = collections.defaultdict(lambda: collections.defaultdict(set))
    for row in rows:
        day = (row["record_time"] - DAY) // 86_400
        peer = f"AS{row['peer_asn']}-{row['peer_address']}"
        for key in ((day, row["collector"], peer), (day, row["collector"], "ALL-PEERS"),
                    (day, "ALL-COLLECTORS", "ALL-PEERS")):
            level = levels[key]
            if row["prefix"] is not None:
                level[row["prefix"]] |= {origin(row["as_path"])} - {None}
    return levels


@pytest.mark.parametrize("seed", range(3))
def test_sets_against_gathered_ones(elems_of, seed):
    rows = rows_of(seed)
    report = as_dict(moas(select_elems(elems_of(*rows), DAY, DAY + 2 * 86_400, "updates")))
    levels = gathered(rows)
    assert set(report) == set(levels)
    for key, prefixes in levels.items():
        for v, is_v6 in (("v4", False), ("v6", True)):
            sets = [found for prefix, found in prefixes.items() if (":" in prefix) == is_v6]
            assert (report[key][f"total_{v}"], report[key][f"moas_pfxs_{v}"],
                    report[key][f"unknown_origin_pfxs_{v}"], report[key][f"origin_sets_{v}"]) == (
                len(sets), sum(len(s) > 1 for s in sets), sum(not s for s in sets),
                len({frozenset(s) for s in sets if len(s) > 1}))


@pytest.mark.parametrize("seed", range(3))
def test_tables_against_gathered_sets(elems_of, seed):
    rows = rows_of(10 + seed)
    selected = select_elems(elems_of(*rows), DAY, DAY + 2 * 86_400, "updates")
    want = {(*key, prefix): sorted(found) for key, prefixes in gathered(rows).items()
            for prefix, found in prefixes.items()}
    for plan, expected in ((prefix_origins, want), (moas_detail, {k: v for k, v in want.items() if len(v) > 1})):
        got = plan(selected).collect()
        assert {((r.time - DAY) // 86_400, r.collector, r.peer, r.prefix): r.origins for r in got} == expected
        assert len(got) == len(expected) and {r.family for r in got} == {4, 6}


def test_sets_of_equal_ends(elems_of):
    """Sets that agree in size, smallest and largest number are told apart by their hashes."""
    rows = [dict(prefix=f"10.{i}.0.0/16", as_path=f"1 {asn}")
            for i, middle in enumerate((5, 6, 7, 6)) for asn in (1, middle, 9)]
    rows += [dict(prefix="11.0.0.0/8", as_path=f"1 {asn}") for asn in ("5", "5.0")]
    rows += [dict(prefix="12.0.0.0/8", as_path=f"1 {asn}") for asn in ("5", "5.1")]
    selected = select_elems(elems_of(*rows), DAY, DAY + 86_400, "updates")
    report = moas(selected).where("peer <> 'ALL-PEERS'").first()
    assert (report.moas_pfxs_v4, report.origin_sets_v4) == (6, 5)
    sets = origin_sets_by_level(origin_facts(selected)).where("level = 0 AND kind = 2")
    assert sorted(row.pfxs for row in sets.collect()) == [1, 1, 1, 1, 2]


def test_contested_prefixes(elems_of):
    rows = [dict(prefix="a", as_path="1 2"), dict(prefix="a", as_path="1 3", collector="rrc01"),
            dict(prefix="b", as_path="1 2"), dict(prefix="b", as_path="4 2", collector="rrc01"),
            dict(prefix="c", as_path="1.1"), dict(prefix="d"), dict(as_path="1 2"), dict(as_path="1 3")]
    facts = origin_facts(select_elems(elems_of(*rows), DAY, DAY + 86_400, "updates"))
    assert sorted(row.prefix for row in contested_prefixes(facts).collect()) == ["a", "c"]
