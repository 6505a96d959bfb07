"""Element counts by bitmaps against those by facts."""

import random

from conftest import DAY

from routelens import select_elems
from routelens.plans import elem_counts, elem_counts_of_close_records


def test_equal_to_facts(elems_of):
    rnd = random.Random(2)
    rows = []
    for _ in range(500):
        peer, collector = rnd.randint(1, 3), rnd.choice(["rrc00", "rrc01"])
        # A record belongs to one collector; ids stand at the ends of ranges, below 0, and far away.
        base = rnd.choice([0, 1, 32_767, 32_768, 32_769, 65_536, -5, 2**40]) + rnd.randint(0, 3)
        rows.append(dict(record_id=2 * base + (collector == "rrc01"), collector=collector, peer_asn=peer,
                         peer_address=f"192.0.2.{peer}", record_time=DAY + 86_400 * rnd.randint(0, 1)))
    selected = select_elems(elems_of(*rows), DAY, DAY + 2 * 86_400, "updates")
    got, want = (sorted(map(tuple, plan(selected).collect())) for plan in (elem_counts_of_close_records, elem_counts))
    assert got == want and len(want) > 10


def test_no_rows(elems_of):
    selected = select_elems(elems_of(dict()), DAY - 86_400, DAY, "updates")
    assert elem_counts_of_close_records(selected).collect() == []
