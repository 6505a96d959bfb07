import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from routelens import select_elems  # noqa: E402
from routelens.plans import REPORTS  # noqa: E402
from routelens.schema import ELEMS  # noqa: E402

DAY = 1_451_606_400


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("routelens-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def elems_of(spark):
    """Elems from dicts that name only what matters."""
    defaults = dict(record_id=1, project="ris", collector="rrc00", record_type="updates",
                    record_time=DAY, peer_asn=1, peer_address="192.0.2.1", prefix=None,
                    as_path=None, communities=None, elem_type="A")

    def make(*rows):
        full = [{**defaults, **row} for row in rows]
        return spark.createDataFrame(
            [tuple(row[name] for name in ELEMS.fieldNames()) for row in full], ELEMS)

    return make


@pytest.fixture(scope="session")
def report_of(elems_of):
    """A report over such elems as {(day number, collector, peer): row dict}."""

    def make(kind, *rows, days=3, **select):
        selected = select_elems(elems_of(*rows), DAY, DAY + days * 86_400, "updates", **select)
        return as_dict(REPORTS[kind](selected))

    return make


def as_dict(report):
    rows = [row.asDict() for row in report.collect()]
    result = {((row["time"] - DAY) // 86_400, row["collector"], row["peer"]): row
              for row in rows}
    assert len(result) == len(rows), "duplicate report rows"
    return result


P1 = (0, "rrc00", "AS1-192.0.2.1")
P2 = (0, "rrc00", "AS2-192.0.2.2")
COLL = (0, "rrc00", "ALL-PEERS")
ALL = (0, "ALL-COLLECTORS", "ALL-PEERS")
ON_P2 = dict(peer_asn=2, peer_address="192.0.2.2")
